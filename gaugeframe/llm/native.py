"""Column expressions shared by the operators that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every contract: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
CONTROLS = r"[\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    """How many `words` a text has; they are counted without being made an array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE)).cast("long")


def utf8(text: Column) -> Column:
    """Bytes of a text; null has none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def md5_uniform(*parts: Column) -> Column:
    """A draw in (0, 1) that depends on the parts alone: 48 bits of an md5, so SQL can repeat it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
