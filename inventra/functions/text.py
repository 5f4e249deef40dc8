"""Text and size expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FILE_TYPES, LARGEST_DUPLICATE, OTHER


def extension(raw: Column) -> Column:
    """A leading dot and lower case; empty stays empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"^\.+", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("."), bare))


def attributes(raw: Column) -> Column:
    """Lower-case attribute words."""
    return F.split(F.trim(F.lower(F.translate(F.coalesce(raw, F.lit("")), ",", " "))), r"\s+")


def has_attribute(raw: Column, name: str) -> Column:
    return F.array_contains(attributes(raw), name)


def human_size(size: Column, gap: str = " ", zero: str | None = None) -> Column:
    """1024 ladder with one decimal; exact halves go to the even digit."""
    value, ladder = size.cast("double"), None
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string(f"%.1f{gap}{unit}", F.bround(value / float(1024**k), 1))
        ladder = F.when(value < float(1024 ** (k + 1)), text) if ladder is None else ladder.when(value < float(1024 ** (k + 1)), text)
    out = ladder.otherwise(F.format_string(f"%.1f{gap}TB", F.bround(value / float(1024**4), 1)))
    return out if zero is None else F.when(F.coalesce(size, F.lit(0)) == 0, zero).otherwise(out)


def file_type(name: Column) -> Column:
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(kinds, ext), F.lit(OTHER)))


def percentage(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", 100.0 * part / total)).otherwise("0%")


def share(part: Column, total: Column, digits: int = 1) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(total > 0, F.round(100.0 * part / total, digits)).otherwise(F.lit(0.0))


def glob(text: Column, pattern: str) -> Column:
    """Shell pattern."""
    return text.rlike(fnmatch.translate(pattern).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$"))


def first_words(text: Column, most: int) -> Column:
    """The first words, only if there are more."""
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) > most, F.array_join(F.slice(words, 1, most), " ")).otherwise(text)


def tail(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def duplicate_key(hash_: Column, size: Column) -> Column:
    blank = F.coalesce(F.trim(hash_), F.lit("")) == ""
    return (
        F.when(blank, F.concat(F.lit("INVALID_HASH_"), F.coalesce(size.cast("string"), F.lit("None"))))
        .when(size.isNull() | (size < 0), F.concat(F.lit("INVALID_SIZE_"), hash_))
        .when(size > LARGEST_DUPLICATE, F.concat(F.lit("OVERFLOW_"), hash_))
        .otherwise(F.concat_ws("_", hash_, size.cast("string")))
    )


def is_duplicate_pair(hash1: Column, size1: Column, hash2: Column, size2: Column) -> Column:
    """Equal non-empty hashes and equal sizes in range; size 0 is allowed here."""
    same = (F.coalesce(hash1, F.lit("")) != "") & hash1.eqNullSafe(hash2) & size1.eqNullSafe(size2) & (size1 >= 0) & (size1 <= LARGEST_DUPLICATE)
    return F.coalesce(same, F.lit(False))


def log_level(line: Column) -> Column:
    out = None
    for level in ("DEBUG", "WARNING", "ERROR", "CRITICAL"):
        test = line.contains(f" [{level}] ")
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise("INFO")


def literal_rows(spark, column: str, values: tuple[str, ...]):
    """A few literal rows, planned as a local relation, so that joins broadcast them."""
    shown = ", ".join("('" + v.replace("'", "\\'") + "')" for v in values)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS t({column})")
