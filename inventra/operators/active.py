"""The canonical views: active files, files with all their responses, files with their current verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UNKNOWN_OWNER

DOMAINS = ("security_class", "rgpd_risk", "finance_type", "legal_type")


def is_active(status: Column) -> Column:
    """Not an error; no status counts as active."""
    return status.isNull() | (status != "error")


def active_files(files: DataFrame) -> DataFrame:
    """Active files with size 0 and owner Unknown where they are missing."""
    owner = F.when(F.coalesce("owner", F.lit("")) == "", UNKNOWN_OWNER).otherwise(F.col("owner"))
    return files.where(is_active(F.col("status"))).select("id", "name", "path", "extension", "fast_hash", F.coalesce("file_size", F.lit(0).cast("long")).alias("file_size"), owner.alias("owner"), "creation_time", "last_modified", "status")


def with_responses(files: DataFrame, responses: DataFrame) -> DataFrame:
    """All responses of each file; files without any stay."""
    return files.join(responses.withColumnRenamed("id", "response_id").withColumnRenamed("fichier_id", "id"), "id", "left")


def current_verdicts(responses: DataFrame) -> DataFrame:
    """The last response of each file."""
    last = F.max_by(F.struct(*DOMAINS), "id").alias("v")
    return responses.groupBy("fichier_id").agg(last).select(F.col("fichier_id").alias("id"), *[F.col("v")[d].alias(d) for d in DOMAINS])


def judged(active: DataFrame, responses: DataFrame) -> DataFrame:
    """Active files with their current verdict."""
    return active.join(current_verdicts(responses), "id", "left")
