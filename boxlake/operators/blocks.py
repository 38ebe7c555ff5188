"""Features of the past for histories that outgrow a task.

The plain operators give a key's whole history to one task. What a row gets
from the past depends on its key and date alone, so here rows are reduced to
what each date adds (its newest value, its last N rows, its sums) by partial
aggregation, features are made for each key and date, and rows look theirs
up. However many rows come, a key has no more dates than the calendar.

A key with more than ``rows`` such reduced rows is cut into blocks of time,
and what later blocks need is carried into them: the newest value (as-of
join), the last N rows (sliding sums), or the sum so far (running totals). A
date lies in one block only. If one date alone outgrows a block, its rows are
dealt to several copies of it, which is cheap since a date needs one carried
value.

Results equal those of the plain operators. The reduced rows are written to
the shared folder, as they are used several times. Cut points and features by
date are broadcast up to :data:`MOST_KEYS` keys and :data:`MOST_DATES` rows,
and joined beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_day
from ..sources.raw import same_keys, work_dir
from .joins import asof_join
from .rolling import counts, prior_rolling

BLOCK_ROWS = 2_000_000
MOST_KEYS = 100_000
MOST_DATES = 200_000


def _small(df: DataFrame) -> DataFrame | None:
    """A table of a few rows for each long history, computed once; None if it has no rows."""
    rows = df.limit(MOST_KEYS + 1).collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MOST_KEYS else df


def _kept(df: DataFrame) -> DataFrame:
    """``df`` in a folder of its own, which stays, as it is part of a lazy result."""
    path = work_dir(df.sparkSession, "dates")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _attached(df: DataFrame, side: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` of the side's row of equal keys, null without one; null keys are keys."""
    side = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *cols)
    on = same_keys(df, side, keys, [f"_k_{k}" for k in keys])
    return df.join(side, on, "left").drop(*[f"_k_{k}" for k in keys])


def _looked_up(df: DataFrame, found: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int) -> DataFrame:
    """Adds ``_f_<col>`` of the row of equal keys among ``n`` rows."""
    found = found.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in cols])
    return _attached(df, F.broadcast(found) if n <= MOST_DATES else found, keys, [f"_f_{c}" for c in cols])


def cut_points(df: DataFrame, by: Sequence[str], date: str, rows: int = BLOCK_ROWS) -> DataFrame | None:
    """(by, _cuts, _weights): days after which a long history is cut, from quantile sketches; None if no key has more than ``rows`` dated rows.

    Two scans of the key and date columns with partial aggregation; rows are
    not moved. A day that is several quantiles at once outgrows a block: its
    weight says into how many copies the block that it ends is dealt.
    """
    days = df.select(*by, epoch_day(date).alias("_day")).where(F.col("_day").isNotNull())
    long = _small(days.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows))
    if long is None:
        return None
    pieces = -(-long.agg(F.max("_n")).first()[0] // rows)
    quantiles = F.percentile_approx("_day", [i / pieces for i in range(1, pieces)], max(10_000, 10 * pieces))
    found = _attached(days, long, by, ["_n"]).where(F.col("_n").isNotNull()).groupBy(*by).agg(quantiles.alias("_q"), F.ceil(F.count("*") / rows).cast("int").alias("_b"))
    wanted = F.transform(F.sequence(F.lit(1), F.col("_b") - 1), lambda i: F.element_at("_q", F.ceil(i * pieces / F.col("_b")).cast("int")))
    found = found.withColumn("_all", wanted).withColumn("_cuts", F.array_distinct("_all"))
    return _small(found.select(*by, "_cuts", F.transform("_cuts", lambda c: F.size(F.filter("_all", lambda x: x == c))).alias("_weights")))


def with_block(df: DataFrame, by: Sequence[str], date: str, cuts: DataFrame) -> DataFrame:
    """Adds ``_block``: 0 for short histories and rows without a date, else the number of cuts before the date; and ``_copies`` of the block."""
    out = _attached(df, cuts, by, ["_cuts", "_weights"])
    out = out.withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < epoch_day(date))), F.lit(0)))
    return out.withColumn("_copies", F.coalesce(F.get("_weights", F.col("_block")), F.lit(1))).drop("_cuts", "_weights")


def asof_parts(left: DataFrame, right: DataFrame, by: Sequence[str], date: str, cols: Sequence[str], tiebreak: Sequence[str], cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_block`` and ``_copy``; the right one with the values carried into each block."""
    rest = list(dict.fromkeys((*tiebreak, *cols)))
    newest = F.max(F.struct(*rest)).alias("_v")  # one row for each date
    right = right.where(F.col(date).isNotNull()).groupBy(*by, date).agg(newest)
    right = with_block(right, by, date, cuts)
    last = right.groupBy(*by, "_block").agg(F.max_by(F.struct(date, "_v"), date).alias("_last"))
    in_order = Window.partitionBy(*by).orderBy("_block")  # one row for each block
    reach = _attached(last, cuts, by, ["_cuts", "_weights"]).withColumn("_to", F.coalesce(F.lead("_block").over(in_order), F.size("_cuts"))).where(F.col("_to") > F.col("_block"))
    carried = reach.select(*by, F.col(f"_last.{date}").alias(date), F.col("_last._v").alias("_v"), "_weights", F.explode(F.sequence(F.col("_block") + 1, F.col("_to"))).alias("_block"))
    carried = carried.withColumn("_copies", F.coalesce(F.get("_weights", F.col("_block")), F.lit(1))).drop("_weights")
    right = right.unionByName(carried).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(*by, date, "_block", "_copy", "_v.*")
    left = with_block(left, by, date, cuts)
    deal = F.when(F.col("_copies") > 1, F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.col("_copies"))).otherwise(0)
    return left.withColumn("_copy", deal.cast("int")).drop("_copies"), right


def _asof_dates(left: DataFrame, right: DataFrame, by: Sequence[str], date: str, cols: Sequence[str], tiebreak: Sequence[str], strict: bool, cuts: DataFrame | None) -> DataFrame:
    """:func:`joins.asof_join`, by block if there are cuts."""
    if cuts is None:
        return asof_join(left, right, by, date, cols, tiebreak, strict)
    a, b = asof_parts(left, right, by, date, cols, tiebreak, cuts)
    return asof_join(a, b, [*by, "_block", "_copy"], date, cols, tiebreak, strict).drop("_block", "_copy")


def asof_join_blocked(left: DataFrame, right: DataFrame, by: Sequence[str], date: str, cols: Sequence[str], tiebreak: Sequence[str] = (), strict: bool = True, rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`joins.asof_join` for keys of any length."""
    newest = right.select(*by, date, F.struct(*dict.fromkeys((*tiebreak, *cols))).alias("_v"))
    asked = left.select(*by, date).distinct().withColumn("_v", F.lit(None).cast(newest.schema["_v"].dataType))
    dates = _kept(asked.unionByName(newest).where(F.col(date).isNotNull()).groupBy(*by, date).agg(F.max("_v").alias("_v")))
    found = _asof_dates(dates.drop("_v"), dates.where(F.col("_v").isNotNull()).select(*by, date, "_v.*"), by, date, cols, tiebreak, strict, cut_points(dates, by, date, rows))
    out = _looked_up(left, found, [*by, date], [f"asof_{c}" for c in cols], dates.count())
    rest = [c for c in left.columns if c not in (*by, date)]
    return out.select(*by, date, *rest, *[F.col(f"_f_asof_{c}").alias(f"asof_{c}") for c in cols])


def trailing_states(past: DataFrame, by: Sequence[str], date: str, tiebreak: Sequence[str], names: Sequence[str], windows: Sequence[int], cuts: DataFrame) -> DataFrame:
    """(by, date, n_N, <name>_sum_N): sums over the last N rows up to each date, a row for each date.

    ``past`` holds the rows that count, with the summed columns ``names``; of
    a date no more than the longest window can matter.
    """
    top, order = max(windows), [date, *tiebreak, *names]
    newest_first = [F.desc(c) for c in order]
    past = with_block(past, by, date, cuts).drop("_copies")
    tail = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*newest_first))
    tails = past.withColumn("_place", tail).where(F.col("_place") <= top).groupBy(*by, "_block").agg(F.collect_list(F.struct(*order)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(-top, -1)  # each block holds a row at least, so these hold the last N
    carried = tails.select(*by, "_block", F.slice(F.sort_array(F.flatten(F.collect_list("_rows").over(earlier)), asc=False), 1, top).alias("_rows"))
    carried = carried.select(*by, "_block", F.inline("_rows")).withColumn("_own", F.lit(False))
    both = past.withColumn("_own", F.lit(True)).unionByName(carried)
    run = Window.partitionBy(*by, "_block").orderBy(*order)
    fields = []
    for n in windows:
        frame = run.rowsBetween(-(n - 1), 0)
        fields.append(F.count(F.lit(1)).over(frame).alias(f"n_{n}"))
        fields += [F.sum(c).over(frame).alias(f"{c}_sum_{n}") for c in names]
    state = both.select(*by, date, *tiebreak, "_own", F.struct(*fields).alias("_state")).where("_own")
    last = F.max(F.struct(*tiebreak, "_state")).alias("_last")
    return state.groupBy(*by, date).agg(last).select(*by, date, "_last._state.*")


def prior_rolling_blocked(df: DataFrame, entity: Sequence[str], date: str, tiebreak: Sequence[str], sums: Mapping[str, Column], windows: Sequence[int], played: Column | None = None, keep_date: bool = False, reset_by: Sequence[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`rolling.prior_rolling` for entities of any length: the last N rows of each date, in blocks with the last N rows before carried into them."""
    by = [*entity, *reset_by]
    dated = df.where(F.col(date).isNotNull()).select(*by, date, *tiebreak, counts(date, played).alias("_on"), *[c.alias(k) for k, c in sums.items()])
    place = F.row_number().over(Window.partitionBy(*by, date).orderBy(*[F.desc(c) for c in ("_on", *tiebreak, *sums)]))
    last = _kept(dated.withColumn("_place", place).where(F.col("_place") <= max(windows)).drop("_place"))
    names = [f"n_{n}" for n in windows] + [f"{k}_sum_{n}" for n in windows for k in sums] + (["last_contributing"] if keep_date else [])
    cuts, keys = cut_points(last, by, date, rows), [*by, date]
    if cuts is None:
        found = prior_rolling(last, entity, date, tiebreak, {k: F.col(k) for k in sums}, windows, F.col("_on"), keep_date, reset_by)
        found = found.select(*keys, *names).dropDuplicates(keys)
    else:
        states = trailing_states(last.where("_on").drop("_on"), by, date, tiebreak, list(sums), windows, cuts).withColumn("last_contributing", F.col(date))
        found = _asof_dates(last.select(*keys).distinct(), states, by, date, names, [], True, cuts)
        found = found.select(*keys, *[F.col(f"asof_{c}").alias(c) for c in names])
    out = _looked_up(df, found, keys, names, last.select(*keys).distinct().count())
    return out.select(*df.columns, *[F.coalesce(f"_f_{c}", F.lit(0)).alias(c) if c.startswith("n_") else F.col(f"_f_{c}").alias(c) for c in names])


def running_totals(daily: DataFrame, by: Sequence[str], date: str, names: Sequence[str], cuts: DataFrame) -> DataFrame:
    """(by, date, names): sums up to each date, given a row for each date; each block starts from the sum of those before."""
    daily = with_block(daily, by, date, cuts)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    start = daily.groupBy(*by, "_block").agg(*[F.sum(c).alias(c) for c in names]).select(*by, "_block", *[F.sum(c).over(before).alias(f"_s_{c}") for c in names])
    run = Window.partitionBy(*by, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    inside = daily.select(*by, "_block", date, *[F.sum(c).over(run).alias(c) for c in names])
    both = _attached(inside, start, [*by, "_block"], [f"_s_{c}" for c in names])
    return both.select(*by, date, *[F.coalesce(F.col(c) + F.col(f"_s_{c}"), c, f"_s_{c}").alias(c) for c in names])


def season_to_date_blocked(df: DataFrame, entity: Sequence[str], season: str, date: str, stats: Sequence[str], played: Column | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`rolling.season_to_date` for entities of any length: sums of each date, in blocks that start from the sum so far."""
    by, on = [*entity, season], counts(date, played)
    names, keys = ["std_n", *[f"std_{s}" for s in stats]], [*entity, season, date]
    daily = _kept(df.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.count_if(on).alias("std_n"), *[F.sum(F.when(on, F.col(s))).alias(f"std_{s}") for s in stats]))
    cuts = cut_points(daily, by, date, rows)
    if cuts is None:
        before = Window.partitionBy(*by).orderBy(epoch_day(date)).rangeBetween(Window.unboundedPreceding, -1)
        found = daily.select(*keys, *[F.sum(c).over(before).alias(c) for c in names])
    else:
        found = _asof_dates(daily.select(*keys), running_totals(daily, by, date, names, cuts), by, date, names, [], True, cuts)
        found = found.select(*keys, *[F.col(f"asof_{c}").alias(c) for c in names])
    out = _looked_up(df, found, keys, names, daily.count())
    return out.select(*df.columns, F.coalesce("_f_std_n", F.lit(0)).alias("std_n"), *[F.col(f"_f_{c}").alias(c) for c in names[1:]])
