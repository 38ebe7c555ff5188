"""Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mmss(c: Column) -> Column:
    """``"34:12"`` to 34.2 minutes; null and empty are 0.0, malformed text is null."""
    part = F.split(c, ":", 2)
    minutes, seconds = (F.get(part, F.lit(i)).try_cast("int") for i in (0, 1))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(minutes + seconds / F.lit(60.0))


def season_label(year: Column) -> Column:
    """2023 to ``2023-24``."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_from_id(c: Column) -> Column:
    return F.right(c, F.lit(4)).try_cast("int")


def season_kind(c: Column) -> Column:
    """pre, regular, playoffs or play-in by the id's first character."""
    first = F.left(c, F.lit(1))
    return F.when(first == "1", "pre").when(first == "2", "regular").when(first == "4", "playoffs").when(first == "5", "play-in")


def epoch_day(date: str | Column) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def clipped(c: Column, low, high) -> Column:
    """Clip that keeps null, which least and greatest would skip."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 3958.8) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def one_hot(c: Column, values: Sequence[str], prefix: str = "is_") -> list[Column]:
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}{v.lower()}") for v in values]


def request_key(*cols: Column) -> Column:
    """Stable 16-hex key over parameters in the order given; null differs from empty."""
    text = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.left(F.sha2(F.concat_ws("|", *text).cast("binary"), 256), F.lit(16))


# Five positions by source position; unknown ones are null.
POSITIONS = {"PG": "PG", "SG": "SG", "SF": "SF", "PF": "PF", "C": "C", "F": "SF", "G": "SG", "F-C": "PF", "C-F": "PF", "G-F": "SF", "F-G": "SF"}


def five_positions(c: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])
    return F.try_element_at(mapping, F.coalesce(F.upper(F.trim(c)), F.lit("")))
