"""Operator 10: line dedup by a log-template tree, in DataFrame functions alone.

A line's path in the tree is its token count, its three leading tokens, and
then an anchor: of its further tokens one, with its position, that most
distinct lines of the leaf have. A line goes to the families of its three
best anchors (a variable field may hold a word that is frequent elsewhere in
the leaf), so a family of lines is judged among its own kind, however many
others share its start. Tokens with a digit are the variable field ``<*>`` and
are never an anchor. In a family a token that more than half of the distinct
lines have at a position is constant, other positions are variable fields. A
line that agrees with the constants in 60 % of its positions after the lead
belongs to the family's template; the lead itself counts for nothing there, as
all lines of a leaf share it. Every line is a template of its own besides; a
line of variable fields alone stands for itself with its digits. Templates
found in ten or more different texts recur; the lines of any that recurs are
dropped.

Lines travel as numbers; only templates in leaves seen in ten texts are looked
at again, each through one of its lines. Exact copies of a text count once.
Lines are separated by ``\\n``, tokens by ASCII white space; lines without
tokens stay and count as lines. A null text has no lines and stays null, the
empty text has one. A document that loses all its lines stays, with the empty
text. Result rows and input rows match one to one, repeated rows and null ids
included, all columns kept; an empty table gives an empty one. Very long texts
and lines are taken whole: time grows with the length of a text, and with the
lines times the dropped lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name

MIN_DOCS, LEAD, ANCHORS, AGREE, FIELD = 10, 3, 3, 0.6, "<*>"
#: Tables of keys are broadcast up to so many rows (some MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
_TEXT = ["_text_hash", "_text_size"]
_LEAF = ["_n", "_leaf"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_text_hash": F.xxhash64("text"), "_text_size": F.length("text")})


def _tokens_of(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def masked_tokens(line: Column) -> Column:
    return F.transform(_tokens_of(line), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def template_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with tokens: text key, place, masked tokens, leaf and template keys."""
    lines = _keyed(docs.select("text").where(F.col("text").isNotNull())).select(*_TEXT, F.posexplode(F.split("text", "\n", -1)).alias("_place", "_line"))
    tokens = lines.select(*_TEXT, "_place", "_line", masked_tokens(F.col("_line")).alias("_tokens")).where(F.size("_tokens") > 0)
    own = F.when(F.exists("_tokens", lambda t: t != FIELD), F.xxhash64("_tokens")).otherwise(F.xxhash64(_tokens_of(F.col("_line"))))
    return tokens.select(*_TEXT, "_place", "_tokens", F.size("_tokens").alias("_n"), F.xxhash64(F.slice("_tokens", 1, LEAD)).alias("_leaf"), own.alias("_template"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` computed once, and broadcast in joins if it has at most :data:`BROADCAST_ROWS` rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _further(templates: DataFrame) -> DataFrame:
    """One row for each constant token after the lead; ``_token`` is its hash."""
    wide = templates.where(F.col("_n") > LEAD).select(*[c for c in templates.columns if c != "_tokens"], F.posexplode("_tokens").alias("_at", "_word"))
    return wide.where((F.col("_at") >= LEAD) & (F.col("_word") != FIELD)).withColumn("_token", F.xxhash64("_word")).drop("_word")


def families(templates: DataFrame, agree: float = AGREE) -> DataFrame:
    """Leaf, template and ``_family`` of the lines that agree with a family of two or more."""
    own = [*_LEAF, "_template"]
    spot = [*_LEAF, "_at", "_token"]
    votes = _small(_further(templates).groupBy(*spot).agg(F.count("*").alias("_votes")))
    best = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("_votes"), "_at"))
    anchors = _further(templates).join(votes.where(F.col("_votes") > 1), spot).withColumn("_place", best).where(F.col("_place") <= ANCHORS)
    anchors = anchors.select(*own, F.xxhash64("_at", "_token").alias("_family"))
    members = checkpointed(templates.join(anchors, own))
    family, tokens = [*_LEAF, "_family"], _further(members)
    # A family of one is its line's own template; in a larger one no constant has a single vote.
    sizes = members.groupBy(*family).agg(F.count("*").alias("_of")).where(F.col("_of") > 1)
    votes = tokens.groupBy(*family, "_at", "_token").agg(F.count("*").alias("_votes")).where(F.col("_votes") > 1)
    constants = _small(votes.join(sizes, family).where(F.col("_votes") * 2 > F.col("_of")).select(*family, "_at", "_token"))
    agreed = tokens.join(constants, [*family, "_at", "_token"], "left_semi").groupBy(*own, "_family").agg(F.count("*").alias("_agreed"))
    return agreed.where(F.col("_agreed") >= agree * (F.col("_n") - LEAD) - 1e-9).drop("_agreed")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, agree: float = AGREE) -> DataFrame:
    """Text key and ``_places``: the places of lines of which a template recurs."""
    lines = checkpointed(template_lines(docs).drop("_tokens"))
    leaves = _small(lines.select(*_LEAF, *_TEXT).distinct().groupBy(*_LEAF).agg(F.count("*").alias("_texts")).where(F.col("_texts") >= min_docs).select(*_LEAF))
    inside = lines.join(leaves, _LEAF, "left_semi")
    # The tokens of a template come from one of its lines.
    shown = checkpointed(inside.groupBy(*_LEAF, "_template").agg(F.min(F.struct(*_TEXT, "_place")).alias("_at")).select(*_LEAF, "_template", "_at.*"))
    texts = _small(shown.select(*_TEXT).distinct())
    some = _keyed(docs.select("text")).join(texts, _TEXT, "left_semi").select("text").distinct()
    templates = checkpointed(template_lines(some).select(*_TEXT, "_place", "_tokens").join(shown, [*_TEXT, "_place"]).select(*_LEAF, "_template", "_tokens"))
    shared = _small(families(templates, agree))
    pairs = checkpointed(inside.select(*_LEAF, "_template", *_TEXT).distinct())
    many = F.count("*") >= min_docs
    alone = pairs.groupBy(*_LEAF, "_template").agg(many.alias("_many")).where("_many").drop("_many")
    by_family = pairs.join(shared, [*_LEAF, "_template"]).select(*_LEAF, "_family", *_TEXT).distinct()
    common = _small(by_family.groupBy(*_LEAF, "_family").agg(many.alias("_many")).where("_many").drop("_many"))
    gone = _small(alone.unionByName(shared.join(common, [*_LEAF, "_family"], "left_semi").drop("_family")).distinct())
    return inside.join(gone, [*_LEAF, "_template"], "left_semi").groupBy(*_TEXT).agg(F.collect_set("_place").alias("_places"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, agree: float = AGREE) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``, and two columns more, the last: ``_n_lines`` and ``_n_removed``.

    If the input has columns of these names, the added ones get further underscores.
    """
    places = checkpointed(recurring_lines(docs, min_docs, agree))  # so that Spark can split a text with many copies in the join
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_places", i))
    # All columns travel in one, so that their names can't clash with ours.
    out = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), "text")).join(places, _TEXT, "left")
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return out.select(
        *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns],
        n_lines.alias(free_name("_n_lines", docs.columns)), F.coalesce(F.size("_places"), F.lit(0)).alias(free_name("_n_removed", docs.columns)))


def digest(cut: DataFrame) -> DataFrame:
    n_lines, n_removed = cut.columns[-2:]
    return cut.select(
        "doc_id", F.col(n_lines).cast("long").alias("n_lines"), F.col(n_removed).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with t as (select distinct text from documents where text is not null),
l0 as (select text, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as place from t),
l1 as (select text, place, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from l0),
l2 as (select text, place, w, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as m from l1 where len(w) > 0),
l as (select text, place, m, len(m) as n, m[1:3] as leaf, case when len(list_filter(m, lambda x: x <> '<*>')) = 0 then w else m end as k from l2),
leaves as (select n, leaf from l group by n, leaf having count(distinct text) >= 10),
ins as (select l.* from l semi join leaves using (n, leaf)),
tm as (select distinct n, leaf, k, m from ins),
tok as (select * from (select n, leaf, k, unnest(m[4:]) as tok, unnest(range(4, n + 1)) as p from tm where n > 3) where tok <> '<*>'),
votes as (select n, leaf, p, tok, count(*) as votes from tok group by n, leaf, p, tok),
fam as (select n, leaf, k, p as fp, tok as ft
        from (select *, row_number() over (partition by n, leaf, k order by votes desc, p) as r from tok join votes using (n, leaf, p, tok)) where r <= 3),
sizes as (select n, leaf, fp, ft, count(*) as total from fam group by n, leaf, fp, ft),
ftok as (select * from tok join fam using (n, leaf, k)),
con as (select n, leaf, fp, ft, p, tok from ftok join sizes using (n, leaf, fp, ft) group by n, leaf, fp, ft, p, tok, total having 2 * count(*) > total),
hit as (select n, leaf, k, fp, ft, count(*) as agreed from ftok join con using (n, leaf, fp, ft, p, tok) group by n, leaf, k, fp, ft),
grp as (select n, leaf, k, 0 as fp, k as g from tm union all
        select n, leaf, k, fp, [ft] as g from hit where agreed >= 0.6 * (n - 3) - 1e-9),
found as (select text, place, n, leaf, fp, g from ins join grp using (n, leaf, k)),
rec as (select n, leaf, fp, g from found group by n, leaf, fp, g having count(distinct text) >= 10),
gone as (select distinct text, place from found semi join rec using (n, leaf, fp, g)),
kept as (select text, string_agg(line, chr(10) order by place) as kept from l0 anti join gone using (text, place) group by text),
cnt as (select text, count(*) as n_removed from gone group by text)
select d.doc_id, cast(case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as bigint) as n_lines,
       cast(coalesce(c.n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k on d.text = k.text left join cnt c on d.text = c.text
"""
