"""Exclusion rules, priority scores, flags, and duplicate guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LARGEST_DUPLICATE, Rules
from ..functions import text as T


def exclusion_reason(rules: Rules = Rules()) -> Column:
    """The first rule that excludes a file, or ok. Uses extension, file_size, file_attributes, path."""
    ext, size = T.extension(F.col("extension")), F.coalesce("file_size", F.lit(0))
    out = F.when(ext.isin(*rules.blocked_extensions), "blocked_extension").when(size < rules.min_size, "too_small").when(size > rules.max_size, "too_large")
    if rules.skip_system:
        out = out.when(T.has_attribute(F.col("file_attributes"), "system"), "system_file")
    if rules.skip_hidden:
        out = out.when(T.has_attribute(F.col("file_attributes"), "hidden"), "hidden_file")
    for pattern in rules.excluded_paths:
        out = out.when(T.glob(F.col("path"), pattern), "excluded_path")
    return out.otherwise("ok")


def priority_score(rules: Rules = Rules()) -> Column:
    ext = T.extension(F.col("extension"))
    size = F.least(F.coalesce("file_size", F.lit(0)) / float(rules.max_size), F.lit(1.0)) * rules.size_weight
    kind = F.when(ext.isin(*rules.high_extensions), float(rules.type_weight)).when(ext.isin(*rules.low_extensions), rules.type_weight * 0.3).otherwise(rules.type_weight * 0.6)
    special = sum((F.when(T.has_attribute(F.col("file_attributes"), a), rules.special_weight / 2).otherwise(0.0) for a in ("hidden", "system")), F.lit(0.0))
    return F.least(size + kind + float(rules.age_weight) + special, F.lit(100.0)).cast("int")


def special_flags() -> Column:
    """hidden_file, system_file, signature_mismatch: the signature doesn't end in the stored extension (with its dot)."""
    ext, signature = F.lower("extension"), F.lower("file_signature")
    differs = (F.coalesce(ext, F.lit("")) != "") & (F.coalesce(signature, F.lit("")) != "") & ~F.endswith(signature, ext)
    flags = [F.when(T.has_attribute(F.col("file_attributes"), "hidden"), "hidden_file"), F.when(T.has_attribute(F.col("file_attributes"), "system"), "system_file"), F.when(differs, "signature_mismatch")]
    return F.array_compact(F.array(*flags))


def true_signature_mismatch() -> Column:
    """The mismatch that is meant: compared without the extension's dot."""
    bare = F.regexp_replace(F.lower("extension"), r"^\.+", "")
    signature = F.lower("file_signature")
    return F.coalesce((bare != "") & (signature != "") & ~F.endswith(signature, bare), F.lit(False))


def ignore_reason() -> Column:
    """Why a file takes no part in duplicate detection, or ok. Uses file_size, fast_hash, path."""
    size = F.coalesce("file_size", F.lit(0))
    return (
        F.when(size == 0, "zero_size_file")
        .when(size > LARGEST_DUPLICATE, "file_too_large")
        .when(F.upper("fast_hash").contains("ERROR"), "hash_error")
        .when(F.lower("path").rlike(r"(\.tmp|\.temp|\.~)$"), "temporary_file")
        .otherwise("ok")
    )


def has_hash() -> Column:
    return F.coalesce(F.trim("fast_hash"), F.lit("")) != ""
