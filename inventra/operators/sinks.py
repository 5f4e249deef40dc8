"""Exports, status updates, backups."""

from __future__ import annotations

import datetime
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SECURITY_CLASSES
from ..sources import shared
from .paging import matching
from .verdicts import DOMAIN_KEYS, mean_confidence

#: Rows of a section of a report.
MOST_REPORT_ROWS = 10_000
_FLAT = {"security": ("security_analysis", "classification"), "rgpd": ("rgpd_analysis", "risk_level"), "finance": ("finance_analysis", "document_type"), "legal": ("legal_analysis", "contract_type")}


def with_status(files: DataFrame, updates: DataFrame) -> DataFrame:
    """Files with the last update (largest seq) of each id; an update sets both status and reason."""
    last = updates.groupBy("id").agg(F.max_by(F.struct("status", "exclusion_reason"), "seq").alias("u"))
    rows = files.join(last, "id", "left")
    for c in ("status", "exclusion_reason"):
        rows = rows.withColumn(c, F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)))
    return rows.drop("u")


def export_rows(joined: DataFrame, status: str | None = None, classification: str | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    rows = matching(joined, status, classification)
    return rows if duplicates is None else rows.join(duplicates.select("id"), "id", "left_semi")


def flat(joined: DataFrame) -> DataFrame:
    """The verdicts from their JSON, N/A where there is none."""
    return joined.select("*", *[F.coalesce(F.get_json_object(c, f"$.{k}"), F.lit("N/A")).alias(n) for n, (c, k) in _FLAT.items()])


def nested(joined: DataFrame) -> DataFrame:
    """id, file_info, analysis."""
    info = [c for c in ("name", "path", "host", "username", "extension", "file_size", "owner", "status", "creation_time", "last_modified", "fast_hash", "file_attributes", "file_signature") if c in joined.columns]
    return flat(joined).select("id", F.struct(*info).alias("file_info"), F.struct(*_FLAT, "resume", "processing_time_ms").alias("analysis"))


def export_statistics(joined: DataFrame) -> DataFrame:
    confidence = mean_confidence(*[F.col(f"{k}_confidence") for k in DOMAIN_KEYS])
    rows = joined.withColumn("_c", confidence)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("error"),
        F.round(F.coalesce(F.avg(F.when(F.col("_c") > 0, F.col("_c"))), F.lit(0.0)), 4).alias("mean_confidence"), *[F.count_if(F.col("security_class") == k).alias(k.lower()) for k in SECURITY_CLASSES],
    )


def listing(joined: DataFrame) -> DataFrame:
    """The seven columns of a list of files (fixed names)."""
    found = flat(joined)
    return found.select(F.col("name").alias("Nom"), F.col("path").alias("Chemin"), F.col("file_size").alias("Taille"), F.col("owner").alias("Propriétaire"), F.col("last_modified").alias("Modifié"), F.coalesce("security_class", F.lit("none")).alias("Classification"), F.coalesce("rgpd_risk", F.lit("none")).alias("Risque RGPD"))


def results_table(joined: DataFrame) -> DataFrame:
    """The nine columns of the results grid (fixed names); the confidence is the mean of those above zero."""
    confidence = mean_confidence(*[F.col(f"{k}_confidence") for k in DOMAIN_KEYS])
    names = {"id": "ID", "path": "File Path", "status": "Status", "security": "Security", "rgpd": "RGPD", "finance": "Finance", "legal": "Legal"}
    return flat(joined).select(*[F.col(c).alias(n) for c, n in names.items()], confidence.alias("Confidence"), F.col("processing_time_ms").alias("Processing Time"))


def call_table(calls: DataFrame) -> DataFrame:
    """The ten columns of a log of test calls (fixed names); hashes are MD5, sizes bytes, issues joined by ";"."""
    md5 = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return calls.select("iteration", "worker_id", "status", "quality_status", "api_duration", "total_duration", F.octet_length(F.coalesce("raw_response", F.lit(""))).alias("response_size"), md5("prompt").alias("prompt_hash"), md5("raw_response").alias("response_hash"), F.array_join("issues", ";").alias("issues"))


def to_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report(sections: dict[str, DataFrame], parameters: dict, advice: list[str] | None = None, timestamp: str | None = None) -> str:
    """A business report as one JSON text: when, parameters, metrics, recommendations. Sections are aggregates of a few rows; a longer one is refused."""
    found = {}
    for name, df in sections.items():
        rows = df.limit(MOST_REPORT_ROWS + 1).collect()
        if len(rows) > MOST_REPORT_ROWS:
            raise ValueError(f"{name} has over {MOST_REPORT_ROWS} rows: export it as a table")
        found[name] = [r.asDict(recursive=True) for r in rows]
    when = timestamp or datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return json.dumps({"timestamp": when, "parameters": parameters, "metrics": found, "recommendations": advice or []}, default=str, ensure_ascii=False, indent=2)


def _put(rows: DataFrame, target: str) -> None:
    """Puts rows in a table's place: written beside it, then moved there, so that a write that breaks leaves the table as it was. The file system must be able to move folders."""
    system, path = shared.open_fs(target)
    new, old = f"{target}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    there = system.get_file_info(path).type != fs.FileType.NotFound
    if there:
        system.move(path, old)
    system.move(shared.open_fs(new)[1], path)
    if there:
        system.delete_dir(old)


def backup(spark: SparkSession, source: str, target: str) -> int:
    """Copies a table's rows; their number."""
    _put(spark.read.parquet(source), target)
    return spark.read.parquet(target).count()


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    _put(spark.read.parquet(source).coalesce(files), target)


def sound(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "path", "file_size", "status", "owner")) -> list[str]:
    """What a files table lacks: columns, or a row that isn't an error."""
    rows = spark.read.parquet(path)
    lacking = [f"no column {c}" for c in columns if c not in rows.columns]
    if not lacking and rows.where("status is null or status <> 'error'").isEmpty():
        lacking.append("no active row")
    return lacking


def restore(spark: SparkSession, saved: str, target: str) -> int:
    """Puts a backup in a table's place; its rows. A backup that isn't sound is refused, and the table stays."""
    if found := sound(spark, saved):
        raise ValueError("; ".join(found))
    return backup(spark, saved, target)


def reset(spark: SparkSession, path: str) -> None:
    """Empties a table; its columns stay."""
    _put(spark.createDataFrame([], spark.read.parquet(path).schema), path)


def repaired(files: DataFrame) -> DataFrame:
    """A files table with one row of each id, unknown statuses as pending, negative sizes as 0. Of rows that share an id, the least by its columns in order stays."""
    known = F.col("status").isin("pending", "completed", "error", "filtered", "cached") | F.col("status").isNull()
    names = [c for c in files.columns if c != "id"]
    rows = files.groupBy("id").agg(F.min(F.struct(*names)).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in names]).select(*files.columns)
    return rows.withColumns({"status": F.when(known, F.col("status")).otherwise("pending"), "file_size": F.greatest("file_size", F.lit(0).cast("long"))})
