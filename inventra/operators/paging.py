"""Pages, keyset pages, ranks and drill-downs. Filters and tags come before any limit; ties fall to the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MB, OTHER, SENSITIVE_LEGAL
from ..functions import dates
from . import ordering
from .active import is_active
from .metrics import period, size_bucket


def pending(files: DataFrame, limit: int | None = None, threshold: int = 0, offset: int = 0) -> DataFrame:
    rows = files.where((F.col("status") == "pending") & (F.col("priority_score") >= threshold)).orderBy(F.col("priority_score").desc(), "id")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def matching(joined: DataFrame, status: str | None = None, classification: str | None = None) -> DataFrame:
    """Equality filters of the grid; no value filters nothing."""
    if status:
        joined = joined.where(F.col("status") == status)
    return joined.where(F.col("security_class") == classification) if classification else joined


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.col("id").desc(), F.col("response_id").desc()).offset(offset).limit(limit)


def whitelisted(files: DataFrame, filters: dict, allowed: tuple[str, ...] = ("status", "extension", "owner")) -> DataFrame:
    """Equality filters on known columns; others are ignored."""
    for name, value in filters.items():
        if name in allowed and name in files.columns:
            files = files.where(F.col(name) == value)
    return files


def keyset(files: DataFrame, cursor: int, limit: int, filters: dict | None = None) -> DataFrame:
    return whitelisted(files, filters or {}).where(F.col("id") > cursor).orderBy("id").limit(limit)


def position(files: DataFrame, target: int, size: int) -> DataFrame:
    """Rank (from 0, largest id first) of a file and its page."""
    return files.agg(F.count_if(F.col("id") > target).alias("rank"), F.count_if(F.col("id") == target).alias("found")).select("rank", F.expr(f"rank div {size}").alias("page"), "found")


def same_hash(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files whose hash is among the hashes."""
    return files.join(hashes.select("fast_hash").distinct(), "fast_hash", "left_semi")


_ROW = ["id", "name", "path", "file_size", "owner", "last_modified"]


def drill(joined: DataFrame, predicate: Column, shown: str | None = None, sized: bool = True) -> DataFrame:
    """Rows of active files for a predicate, the largest first."""
    rows = joined.where(is_active(F.col("status")) & predicate)
    if sized:
        rows = rows.where("file_size > 0")
    columns = [*_ROW, *([F.coalesce(shown, F.lit("N/A")).alias("verdict")] if shown else [])]
    return rows.orderBy(F.col("file_size").desc(), "id").select(*columns)


def category(column: str, value: str, known: tuple[str, ...], none_is_null: bool = False) -> Column:
    """A verdict, or the rest: no verdict or an unknown one."""
    if value == OTHER:
        return F.col(column).isNull() | ~F.col(column).isin(*known)
    if none_is_null and value == "none":
        return F.col(column).isNull() | (F.col(column) == "none")
    return F.col(column) == value


def in_bucket(value: str) -> Column:
    return size_bucket(F.coalesce("file_size", F.lit(0))) == value


def in_period(as_of: str, value: str, date: str) -> Column:
    """Period of the chosen date, with the other where it can't be read."""
    first, second = ("last_modified", "creation_time") if date == "modification" else ("creation_time", "last_modified")
    moment = F.coalesce(dates.parse_flexible(F.col(first)), dates.parse_flexible(F.col(second)))
    return period(as_of, moment, False) == value


def older(as_of: str, days: int) -> Column:
    return dates.reliable_time(F.col("last_modified"), F.col("creation_time")) < dates.days_before(as_of, days)


AGES = ("recent_7_days", "recent_30_days", "recent_90_days", "old_1_year", "old_2_years", "dormant")


def aged(joined: DataFrame, as_of: str, category: str, field: str = "last_modified", days: int = 365) -> DataFrame:
    """Files of a category of age by one date, the oldest first; the date is compared as a date."""
    moment, ago = dates.parse_time(F.col(field)), lambda n: dates.days_before(as_of, n)
    years = lambda n: F.to_timestamp(F.lit(as_of)) - F.expr(f"make_ym_interval({n})")
    test = {
        "recent_7_days": moment >= ago(7), "recent_30_days": (moment >= ago(30)) & (moment < ago(7)), "recent_90_days": (moment >= ago(90)) & (moment < ago(30)),
        "old_1_year": moment < years(1), "old_2_years": moment < years(2), "dormant": moment < ago(days),
    }[category]
    rows = joined.where(is_active(F.col("status")) & (F.col("file_size") > 0) & test).orderBy(moment, "id")
    return rows.select("id", "name", "path", "file_size", field, "owner", F.coalesce("security_class", F.lit("none")).alias("classif"), F.coalesce("rgpd_risk", F.lit("none")).alias("rgpd"))


COMBINED = {
    "c3_critical": lambda: (F.col("security_class") == "C3") & (F.col("rgpd_risk") == "critical"),
    "c3_legal": lambda: (F.col("security_class") == "C3") & F.col("legal_type").isin(*SENSITIVE_LEGAL),
    "c3_total": lambda: F.col("security_class") == "C3",
}


def of_owner(owner: str, kind: str) -> Column:
    test = {"large": F.col("file_size") > 100_000_000, "c3": F.col("security_class") == "C3", "critical": F.col("rgpd_risk") == "critical"}.get(kind, F.lit(True))
    return (F.col("owner") == owner) & test


def at_least(level: str) -> Column:
    """Ordinal classes: C1 stands for C1 and all above."""
    return F.col("security_class").isin(*[f"C{i}" for i in range(int(level[1]), 4)])


def large_ids(files: DataFrame, mb: int) -> DataFrame:
    return files.where(F.col("file_size") >= mb * MB).select("id")


def positions(rows: DataFrame, within: list[str], parts: int | None = None) -> DataFrame:
    """Each row's place (from 0) among those of its keys, the largest id first. One key's rows may lie in many tasks."""
    given = rows.withColumn("_down", -F.col("id"))
    return ordering.running(given, within, ["_down"], "_down", "_down", 1, parts).withColumn("position", (F.col("run_number") - 1).cast("int")).select(*rows.columns, "position")


def last_first(rows: DataFrame, by: list[Column], most: int, within: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= most)
