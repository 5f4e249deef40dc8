"""Distributions and metrics over files and verdicts. Small fixed dimensions are joined so that empty categories are rows of zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GB, MB, OTHER, SENSITIVE_LEGAL, SIZE_BUCKETS, YEAR_BUCKETS
from ..functions import dates
from ..functions.text import literal_rows, share


def whole(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def gb(c: Column) -> Column:
    return F.round(whole(c) / float(GB), 4)


def distribution(joined: DataFrame, column: str) -> DataFrame:
    """Count and bytes by verdict over all responses; no verdict counts as none."""
    return joined.groupBy(F.coalesce(column, F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n_files"), whole(F.sum("file_size")).alias("total_size"))


def four_domains(joined_active: DataFrame) -> DataFrame:
    return joined_active.groupBy("security_class", "rgpd_risk", "finance_type", "legal_type").agg(F.count(F.lit(1)).alias("n_files"), whole(F.sum("file_size")).alias("total_size"))


def thematic(joined: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """The fixed categories and the rest, with percentages of the total."""
    kind = F.when(F.coalesce(column, F.lit("none")).isin(*known), F.coalesce(column, F.lit("none"))).otherwise(OTHER)
    found = joined.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    every = literal_rows(joined.sparkSession, "category", (*known, OTHER))
    rows = every.join(found, "category", "left")
    total = F.sum(whole(F.col("n"))).over(Window.partitionBy())  # a handful of category rows
    return rows.select("category", whole(F.col("n")).alias("n_files"), whole(F.col("bytes")).alias("total_size"), share(whole(F.col("n")), total).alias("percentage"))


def by_status(files: DataFrame) -> DataFrame:
    """Count and bytes of each status and in all."""
    rows = files.rollup("status").agg(F.grouping("status").alias("g"), F.count(F.lit(1)).alias("n_files"), whole(F.sum("file_size")).alias("total_size"))
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.coalesce("status", F.lit("NULL"))).alias("status"), "n_files", "total_size")


def processing(files: DataFrame, responses: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    times = responses.agg(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("mean_ms"))
    return files.agg(F.count(F.lit(1)).alias("total"), n("pending"), n("processing"), n("completed"), n("error")).join(F.broadcast(times)).withColumn("mean_ms", F.round("mean_ms", 4))


def alert_flags(judged: DataFrame) -> DataFrame:
    """The two definitions of critical files as flags: alert_2way and alert_3way hold super, critical or null."""
    c3, risk, legal = (F.coalesce(c, F.lit(False)) for c in (F.col("security_class") == "C3", F.col("rgpd_risk") == "critical", F.col("legal_type").isin(*SENSITIVE_LEGAL)))
    two = F.when(c3 & risk, "super_critical").when(c3 | risk, "critical")
    three = F.when(c3 & risk & legal, "super_critical").when(c3 | risk | legal, "critical")
    return judged.withColumn("alert_2way", two).withColumn("alert_3way", three)


def alerts(judged: DataFrame, column: str) -> DataFrame:
    """Count, percentage and size of super_critical and critical files, in one pass."""
    flagged = alert_flags(judged)
    kinds = ("super_critical", "critical")
    wide = flagged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == k).alias(f"n_{k}") for k in kinds], *[F.sum(F.when(F.col(column) == k, F.col("file_size"))).alias(f"b_{k}") for k in kinds])
    rows = wide.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"n_{k}").alias("n"), F.col(f"b_{k}").alias("b")) for k in kinds])).alias("r"))
    return rows.select(F.col("r.category").alias("category"), F.col("r.n").alias("n_files"), share(F.col("r.n"), F.col("total")).alias("percentage"), gb(F.col("r.b")).alias("size_gb"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total_files"), gb(F.sum("file_size")).alias("total_size_gb"))


def size_and_age(files: DataFrame, as_of: str, large_mb: int = 100, days: int = 365) -> DataFrame:
    """Large and dormant files; archival adds both, so that a file that is both counts twice in it, and affected counts it once."""
    large = F.col("file_size") >= large_mb * MB
    dormant = F.coalesce(dates.reliable_time(F.col("last_modified"), F.col("creation_time")) <= dates.days_before(as_of, days), F.lit(False))
    both = files.withColumn("_l", large).withColumn("_d", dormant)
    wide = both.agg(F.count(F.lit(1)).alias("n"), F.count_if("_l").alias("large"), F.count_if("_d").alias("dormant"), F.count_if(F.col("_l") | F.col("_d")).alias("total_affected"), whole(F.sum(F.when(F.col("_l"), F.col("file_size")))).alias("bl"), whole(F.sum(F.when(F.col("_d"), F.col("file_size")))).alias("bd"))
    return wide.select(F.col("large").alias("large_files"), share(F.col("large"), F.col("n")).alias("large_files_pct"), F.col("dormant").alias("dormant_files"), share(F.col("dormant"), F.col("n")).alias("dormant_files_pct"), gb(F.col("bl") + F.col("bd")).alias("archival_size_gb"), "total_affected")


def size_bucket(size: Column) -> Column:
    out = None
    for name, _, high in SIZE_BUCKETS:
        out = (F.when(size < high * MB, name) if out is None else out.when(size < high * MB, name)) if high else out.otherwise(name)
    return out


def _with_every(found: DataFrame, names: list[str], total: DataFrame) -> DataFrame:
    every = literal_rows(found.sparkSession, "category", tuple(names))
    rows = every.join(found, "category", "left").join(F.broadcast(total))
    return rows.select("category", whole(F.col("n")).alias("n_files"), share(whole(F.col("n")), F.col("total")).alias("percentage"), gb(F.col("bytes")).alias("size_gb"))


def size_distribution(files: DataFrame) -> DataFrame:
    found = files.groupBy(size_bucket(F.col("file_size")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    return _with_every(found, [b[0] for b in SIZE_BUCKETS], files.agg(F.count(F.lit(1)).alias("total")))


def coarse_sizes(files: DataFrame) -> DataFrame:
    size = F.col("file_size")
    kind = F.when(size < MB, "<1MB").when(size < 10 * MB, "1-10MB").when(size < 100 * MB, "10-100MB").otherwise(">100MB")
    found = files.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    every = literal_rows(files.sparkSession, "category", ("<1MB", "1-10MB", "10-100MB", ">100MB"))
    rows = every.join(found, "category", "left").join(F.broadcast(files.agg(F.count(F.lit(1)).alias("total"))))
    return rows.select("category", whole(F.col("n")).alias("n_files"), share(whole(F.col("n")), F.col("total"), 2).alias("percentage"))


def large_files(files: DataFrame, mb: int) -> DataFrame:
    return files.where(F.col("file_size") >= mb * MB)


def space(files: DataFrame) -> DataFrame:
    """Count, bytes, MB."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), whole(F.sum("file_size")).alias("total_size"), F.round(whole(F.sum("file_size")) / float(MB), 2).alias("size_mb"))


def size_statistics(files: DataFrame) -> DataFrame:
    mb = lambda c: F.round(F.coalesce(c, F.lit(0.0)) / float(MB), 4)
    return files.agg(mb(F.avg("file_size")).alias("mean_mb"), mb(F.min("file_size")).alias("min_mb"), mb(F.max("file_size")).alias("max_mb"))


def with_time(files: DataFrame) -> DataFrame:
    return files.withColumn("ts", dates.reliable_time(F.col("last_modified"), F.col("creation_time")))


def years(files: DataFrame) -> DataFrame:
    """Share of dated files by year."""
    dated = with_time(files).where("ts is not null")
    found = dated.groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_files"))
    return found.join(F.broadcast(dated.agg(F.count(F.lit(1)).alias("total")))).select("year", "n_files", share(F.col("n_files"), F.col("total"), 2).alias("percentage"))


def stale(files: DataFrame, as_of: str, days: int) -> DataFrame:
    return with_time(files).where(F.col("ts") <= dates.days_before(as_of, days))


def age_statistics(files: DataFrame, as_of: str) -> DataFrame:
    days = dates.whole_days(as_of, F.col("ts"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return with_time(files).where("ts is not null").agg(F.round(zero(F.avg(days)), 4).alias("mean_days"), whole(F.min(days)).alias("min_days"), whole(F.max(days)).alias("max_days"))


def period(as_of: str, moment: Column, closed_above: bool) -> Column:
    """The age period: (low, high] of moments if closed_above, else [low, high); the last holds all from its start on. The moment is evaluated once."""
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(moment)) / (365 * 86400 * 1e6)
    n = F.lit(len(YEAR_BUCKETS) - 1)
    index = F.width_bucket(age, F.lit(0.0), F.lit(6.0), n) - 1 if closed_above else n - F.width_bucket(-age, F.lit(-6.0), F.lit(0.0), n)
    return F.get(F.array(*[F.lit(name) for name, _, _ in YEAR_BUCKETS]), index.cast("int"))


def temporal(files: DataFrame, as_of: str, mode: str) -> DataFrame:
    """Active files of a size by age of modification or creation; percentages of the dated ones."""
    moment = dates.parse_flexible(F.col("last_modified" if mode == "modification" else "creation_time"))
    dated = files.where("file_size > 0").withColumn("ts", moment).where("ts is not null")
    found = dated.groupBy(period(as_of, F.col("ts"), True).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    return _with_every(found, [b[0] for b in YEAR_BUCKETS], dated.agg(F.count(F.lit(1)).alias("total")))


def top_owners(judged: DataFrame, most: int = 10) -> DataFrame:
    """For large files, C3 and critical files: the first owners, by bytes for large files, else by count; ties by first file."""
    kinds = F.array_compact(F.array(F.when(F.col("file_size") > 100 * MB, "large"), F.when(F.col("security_class") == "C3", "c3"), F.when(F.col("rgpd_risk") == "critical", "critical")))
    per = judged.select("id", "owner", "file_size", F.explode(kinds).alias("category")).groupBy("category", "owner").agg(F.count(F.lit(1)).alias("n_files"), whole(F.sum("file_size")).alias("total_size"), F.min("id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.when(F.col("category") == "large", F.col("total_size")).otherwise(F.col("n_files")).desc(), "first_id"))
    return per.withColumn("rank", rank).where(F.col("rank") <= most).select("category", "rank", "owner", "n_files", "total_size")


def recommendations(figures: DataFrame) -> DataFrame:
    """At most five messages from one row of figures: super_critical, critical, wasted_gb, groups, archival_gb, affected, total_gb, total_files."""
    f = F.format_string
    rules = [
        F.when(F.col("super_critical") > 0, f("URGENT: %d super critical files need action now", "super_critical")),
        F.when(F.col("critical") > 10, f("PRIORITY: %d critical files to treat soon", "critical")),
        F.when(F.col("wasted_gb") > 1.0, f("SPACE: %.1fGB wasted in %d groups of duplicates", "wasted_gb", "groups")),
        F.when(F.col("archival_gb") > 5.0, f("ARCHIVE: %.1fGB in %d old or large files", "archival_gb", "affected")),
        F.when(F.col("total_gb") > 100, F.lit("CAPACITY: watch the disk space")),
        F.when((F.col("super_critical") > 0) | (F.col("critical") > 50), F.lit("SECURITY: audit the sensitive files")),
        F.when(F.col("total_files") > 100_000, F.lit("PERFORMANCE: consider an index for large volumes")),
    ]
    said = F.array_compact(F.array(*rules))
    said = F.when(F.size(said) == 0, F.array(F.lit("No particular recommendation"))).otherwise(F.slice(said, 1, 5))
    return figures.select(F.posexplode(said).alias("position", "message"))
