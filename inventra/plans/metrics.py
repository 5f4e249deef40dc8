"""Registered metrics (G), duplicate rules (H) and age or size row operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, FINANCE_TYPES, GDPR_RISKS, LEGAL_TYPES, SECURITY_CLASSES
from ..functions import dates
from ..functions import text as T
from ..operators import duplicates as D
from ..operators import metrics as M
from ..operators import paging as P
from ..operators import rules, verdicts
from ..operators.active import is_active
from .base import AS_OF_SQL, ALERT2, ALERT3, ELIGIBLE, FAMILIES, HASHED, IGNORE, RELIABLE, SIZE_BUCKET, confidence_sql, gb_sql, parse_creation, parse_flexible, period_sql, query, share_sql

_DOMAINS = {"security": ("security_class", SECURITY_CLASSES), "rgpd": ("rgpd_risk", GDPR_RISKS), "finance": ("finance_type", FINANCE_TYPES), "legal": ("legal_type", LEGAL_TYPES)}

for _name, (_column, _known) in _DOMAINS.items():
    query(f"g1_distribution_{_name}", f"SELECT coalesce({_column}, 'none') AS category, count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS total_size FROM joined GROUP BY 1")(lambda t, c=_column: M.distribution(t.joined, c))
    _list = ", ".join(f"('{k}')" for k in (*_known, "Autres"))
    _in = ", ".join(f"'{k}'" for k in _known)
    query(
        f"g3_thematic_{_name}",
        f", k AS (SELECT CASE WHEN coalesce({_column}, 'none') IN ({_in}) THEN coalesce({_column}, 'none') ELSE 'Autres' END AS category, count(*) AS n, sum(file_size) AS b FROM joined GROUP BY 1) SELECT c.category, coalesce(n, 0)::BIGINT AS n_files, coalesce(b, 0)::BIGINT AS total_size, {share_sql('coalesce(n, 0)', '(SELECT sum(n) FROM k)')} AS percentage FROM (VALUES {_list}) c(category) LEFT JOIN k USING (category)",
    )(lambda t, c=_column, k=_known: M.thematic(t.joined, c, k))


@query("g2_four_domains", "SELECT security_class, rgpd_risk, finance_type, legal_type, count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS total_size FROM joined WHERE status IS NULL OR status <> 'error' GROUP BY 1, 2, 3, 4")
def _(t):
    return M.four_domains(t.joined.where(is_active(F.col("status"))))


@query("g4_by_status", "SELECT coalesce(status, 'NULL') AS status, count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS total_size FROM files GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), coalesce(sum(file_size), 0)::BIGINT FROM files")
def _(t):
    return M.by_status(t.files)


@query("g5_processing", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS error, (SELECT round(coalesce(avg(processing_time_ms), 0), 4) FROM responses) AS mean_ms FROM files")
def _(t):
    return M.processing(t.files, t.responses)


@query("g6_name_duplicates", "SELECT name, count(*) AS n FROM files GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return D.by_name(t.files)


@query("g6_name_duplicates_total", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS total_duplicates, count(*) AS names FROM (SELECT count(*) AS n FROM files GROUP BY name HAVING count(*) > 1)")
def _(t):
    return D.by_name(t.files).agg(M.whole(F.sum(F.col("n") - 1)).alias("total_duplicates"), F.count(F.lit(1)).alias("names"))


@query("g7_families", f"SELECT * FROM {FAMILIES}")
def _(t):
    return D.families(t.active)


_STATS = f"""SELECT count(*) AS families, coalesce(sum(n), 0)::BIGINT AS files, count(*) AS sources, coalesce(sum(n - 1), 0)::BIGINT AS copies, coalesce(sum((n - 1) * file_size), 0)::BIGINT AS wasted_bytes,
round(coalesce(sum((n - 1) * file_size), 0)::DOUBLE / 1048576, 2) AS wasted_mb, coalesce(max(n), 0) AS largest, round(coalesce(avg(n), 0.0), 2) AS mean_size FROM {FAMILIES}"""


@query("g8_duplicate_statistics", _STATS)
def _(t):
    return D.statistics(t.active)


@query("g8_duplicate_statistics_empty", _STATS.replace("FROM active WHERE", "FROM active WHERE file_size < 0 AND"))
def _(t):
    return D.statistics(t.active.where("file_size < 0"))


@query("g8_histogram", f"SELECT n AS copies, count(*) AS families FROM {FAMILIES} GROUP BY 1")
def _(t):
    return D.histogram(t.active)


_SOURCE = f"(SELECT fast_hash, file_size, count(*) AS n, first(id ORDER BY coalesce({parse_creation('creation_time')}, timestamp '9999-12-31'), id) AS source_id FROM active WHERE {ELIGIBLE} GROUP BY 1, 2 HAVING count(*) > 1)"


@query("g9_copies", f"SELECT fast_hash, file_size, n, n - 1 AS copies, source_id FROM {_SOURCE}")
def _(t):
    return D.sources(t.active).select("fast_hash", "file_size", "n", (F.col("n") - 1).alias("copies"), "source_id")


@query("g10_files_duplicated_n_times", f"SELECT k.n AS times, coalesce(sum(f.n), 0)::BIGINT AS n_files FROM (VALUES (2), (3), (4)) k(n) LEFT JOIN {FAMILIES} f ON f.n = k.n GROUP BY 1")
def _(t):
    one = D.families(t.active).agg(*[M.whole(F.sum(F.when(F.col("n") == k, F.col("n")))).alias(str(k)) for k in (2, 3, 4)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("times"), F.col(str(k)).alias("n_files")) for k in (2, 3, 4)])).alias("r")).select("r.times", "r.n_files")


@query("g11_duplicate_levels", f", k AS (SELECT fast_hash, file_size, count(*) AS n FROM active WHERE coalesce(fast_hash, '') <> '' GROUP BY 1, 2), l AS (SELECT CASE WHEN n >= 7 THEN '7x+' ELSE n::VARCHAR || 'x' END AS level, sum(n) AS files, sum(n * file_size) AS b, count(*) AS families FROM k GROUP BY 1) SELECT v.level, coalesce(files, 0)::BIGINT AS files, {share_sql('coalesce(files, 0)', '(SELECT sum(n) FROM k)')} AS percentage, {gb_sql('b')} AS size_gb, coalesce(families, 0)::BIGINT AS families FROM (VALUES ('1x'), ('2x'), ('3x'), ('4x'), ('5x'), ('6x'), ('7x+')) v(level) LEFT JOIN l USING (level)")
def _(t):
    return D.level_metrics(t.active)


@query("g12_duplicate_summary", f"SELECT coalesce(sum(CASE WHEN n = 2 THEN n END), 0)::BIGINT AS files_2x, count(*) AS total_groups, {gb_sql('sum((n - 1) * file_size)')} AS wasted_space_gb FROM {FAMILIES}")
def _(t):
    return D.families(t.active).agg(M.whole(F.sum(F.when(F.col("n") == 2, F.col("n")))).alias("files_2x"), F.count(F.lit(1)).alias("total_groups"), M.gb(F.sum((F.col("n") - 1) * F.col("file_size"))).alias("wasted_space_gb"))


@query("g13_grid_duplicate_statistics", _STATS.replace("FROM active WHERE", "FROM judged WHERE security_class = 'C0' AND"))
def _(t):
    return D.statistics(t.judged.where("security_class = 'C0'"))


for _way, _flag in (("2way", ALERT2), ("3way", ALERT3)):
    query(f"g{14 if _way == '2way' else 15}_alerts_{_way}", f", f AS (SELECT *, {_flag} AS alert FROM judged) SELECT k.category, count(f.id) AS n_files, {share_sql('count(f.id)', '(SELECT count(*) FROM judged)')} AS percentage, {gb_sql('sum(f.file_size)')} AS size_gb FROM (VALUES ('super_critical'), ('critical')) k(category) LEFT JOIN f ON f.alert = k.category GROUP BY 1")(lambda t, w=_way: M.alerts(t.judged, f"alert_{w}"))


@query("g16_totals", f"SELECT count(*) AS total_files, {gb_sql('sum(file_size)')} AS total_size_gb FROM active")
def _(t):
    return M.totals(t.active)


_DORMANT = f"coalesce({RELIABLE} <= {AS_OF_SQL} - to_days(365), false)"


@query("g17_size_and_age", f", f AS (SELECT file_size, file_size >= 104857600 AS l, {_DORMANT} AS d FROM active) SELECT count(*) FILTER (l) AS large_files, {share_sql('count(*) FILTER (l)', 'count(*)')} AS large_files_pct, count(*) FILTER (d) AS dormant_files, {share_sql('count(*) FILTER (d)', 'count(*)')} AS dormant_files_pct, {gb_sql('coalesce(sum(file_size) FILTER (l), 0) + coalesce(sum(file_size) FILTER (d), 0)')} AS archival_size_gb, count(*) FILTER (l OR d) AS total_affected FROM f")
def _(t):
    return M.size_and_age(t.active, AS_OF)


@query("g18_coarse_sizes", f", k AS (SELECT CASE WHEN file_size < 1048576 THEN '<1MB' WHEN file_size < 10485760 THEN '1-10MB' WHEN file_size < 104857600 THEN '10-100MB' ELSE '>100MB' END AS category, count(*) AS n FROM active GROUP BY 1) SELECT v.category, coalesce(n, 0)::BIGINT AS n_files, {share_sql('coalesce(n, 0)', '(SELECT count(*) FROM active)', 2)} AS percentage FROM (VALUES ('<1MB'), ('1-10MB'), ('10-100MB'), ('>100MB')) v(category) LEFT JOIN k USING (category)")
def _(t):
    return M.coarse_sizes(t.active)


@query("g19_size_distribution", f", k AS (SELECT {SIZE_BUCKET} AS category, count(*) AS n, sum(file_size) AS b FROM active GROUP BY 1) SELECT v.category, coalesce(n, 0)::BIGINT AS n_files, {share_sql('coalesce(n, 0)', '(SELECT count(*) FROM active)')} AS percentage, {gb_sql('b')} AS size_gb FROM (VALUES ('<50MB'), ('50-100MB'), ('100-150MB'), ('150-200MB'), ('200-300MB'), ('300-500MB'), ('>500MB')) v(category) LEFT JOIN k USING (category)")
def _(t):
    return M.size_distribution(t.active)


@query("g20_large_files", "SELECT count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS total_size, round(coalesce(sum(file_size), 0)::DOUBLE / 1048576, 2) AS size_mb FROM active WHERE file_size >= 104857600")
def _(t):
    return M.space(M.large_files(t.active, 100))


@query("g21_size_statistics", "SELECT round(coalesce(avg(file_size), 0) / 1048576, 4) AS mean_mb, round(coalesce(min(file_size), 0)::DOUBLE / 1048576, 4) AS min_mb, round(coalesce(max(file_size), 0)::DOUBLE / 1048576, 4) AS max_mb FROM active")
def _(t):
    return M.size_statistics(t.active)


@query("g22_years", f", d AS (SELECT {RELIABLE} AS ts FROM active) SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS n_files, {share_sql('count(*)', '(SELECT count(ts) FROM d)', 2)} AS percentage FROM d WHERE ts IS NOT NULL GROUP BY 1")
def _(t):
    return M.years(t.active)


@query("g23_archival_candidates", f"SELECT count(*) AS n_files, coalesce(sum(file_size), 0)::BIGINT AS total_size, round(coalesce(sum(file_size), 0)::DOUBLE / 1048576, 2) AS size_mb FROM active WHERE {RELIABLE} <= {AS_OF_SQL} - to_days(180)")
def _(t):
    return M.space(M.stale(t.active, AS_OF, 180))


@query("g24_age_statistics", f", d AS (SELECT CAST(floor((epoch({AS_OF_SQL}) - floor(epoch({RELIABLE}))) / 86400) AS BIGINT) AS n FROM active) SELECT round(coalesce(avg(n), 0), 4) AS mean_days, coalesce(min(n), 0) AS min_days, coalesce(max(n), 0) AS max_days FROM d WHERE n IS NOT NULL")
def _(t):
    return M.age_statistics(t.active, AS_OF)


for _mode, _date in (("modification", "last_modified"), ("creation", "creation_time")):
    query(f"g25_temporal_{_mode}", f", d AS (SELECT file_size, {parse_flexible(_date)} AS ts FROM active WHERE file_size > 0), k AS (SELECT {period_sql('ts', True)} AS category, count(*) AS n, sum(file_size) AS b FROM d WHERE ts IS NOT NULL GROUP BY 1) SELECT v.category, coalesce(n, 0)::BIGINT AS n_files, {share_sql('coalesce(n, 0)', '(SELECT count(ts) FROM d)')} AS percentage, {gb_sql('b')} AS size_gb FROM (VALUES ('0_1y'), ('1_2y'), ('2_3y'), ('3_4y'), ('4_5y'), ('5_6y'), ('6plus')) v(category) LEFT JOIN k USING (category)")(lambda t, m=_mode: M.temporal(t.active, AS_OF, m))


@query("g27_top_owners", ", k AS (SELECT id, owner, file_size, unnest(list_filter([CASE WHEN file_size > 104857600 THEN 'large' END, CASE WHEN security_class = 'C3' THEN 'c3' END, CASE WHEN rgpd_risk = 'critical' THEN 'critical' END], lambda x: x IS NOT NULL)) AS category FROM judged), o AS (SELECT category, owner, count(*) AS n_files, sum(file_size)::BIGINT AS total_size, min(id) AS f FROM k GROUP BY 1, 2) SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'large' THEN total_size ELSE n_files END DESC, f) AS INTEGER) AS rank, owner, n_files, total_size FROM o QUALIFY rank <= 10")
def _(t):
    return M.top_owners(t.judged)


@query("g29_domain_confidence", f"SELECT id, {confidence_sql('security_confidence', 'rgpd_confidence', 'finance_confidence', 'legal_confidence')} AS confidence_global FROM responses")
def _(t):
    return t.responses.select("id", verdicts.mean_confidence(*[F.col(f"{k}_confidence") for k in verdicts.DOMAIN_KEYS]).alias("confidence_global"))


@query("g30_run_totals", "SELECT (SELECT coalesce(sum(processing_time_ms), 0)::BIGINT FROM responses) AS total_ms, count(*) FILTER (status = 'error') AS n_errors FROM files")
def _(t):
    return t.files.agg(F.count_if(F.col("status") == "error").alias("n_errors")).join(F.broadcast(t.responses.agg(M.whole(F.sum("processing_time_ms")).alias("total_ms"))))


@query("h1_ignore_reason", f"SELECT id, {IGNORE} AS reason FROM files")
def _(t):
    return t.files.select("id", rules.ignore_reason().alias("reason"))


@query("h2_valid_hash", f"SELECT id, {HASHED} AS valid FROM files")
def _(t):
    return t.files.select("id", rules.has_hash().alias("valid"))


@query("h3_duplicate_key", "SELECT id, CASE WHEN coalesce(trim(fast_hash), '') = '' THEN 'INVALID_HASH_' || coalesce(file_size::VARCHAR, 'None') WHEN file_size IS NULL OR file_size < 0 THEN 'INVALID_SIZE_' || fast_hash WHEN file_size > 281474976710656 THEN 'OVERFLOW_' || fast_hash ELSE fast_hash || '_' || file_size::VARCHAR END AS key FROM files")
def _(t):
    return t.files.select("id", T.duplicate_key(F.col("fast_hash"), F.col("file_size")).alias("key"))


@query("h4_duplicate_pairs", "SELECT a.id AS id1, b.id AS id2, coalesce(coalesce(a.fast_hash, '') <> '' AND a.fast_hash = b.fast_hash AND a.file_size = b.file_size AND a.file_size BETWEEN 0 AND 281474976710656, false) AS duplicate FROM files a JOIN files b ON a.name = b.name AND a.id < b.id")
def _(t):
    a, b = (t.files.select("name", F.col("id").alias(f"id{k}"), F.col("fast_hash").alias(f"h{k}"), F.col("file_size").alias(f"s{k}")) for k in (1, 2))
    return a.join(b, "name").where("id1 < id2").select("id1", "id2", T.is_duplicate_pair(F.col("h1"), F.col("s1"), F.col("h2"), F.col("s2")).alias("duplicate"))


@query("h5_sources", f"SELECT source_id, fast_hash, n FROM {_SOURCE}")
def _(t):
    return D.sources(t.active).select("source_id", "fast_hash", "n")


@query("h6_tags", f"SELECT a.id, CASE WHEN s.source_id IS NOT NULL AND ({ELIGIBLE.replace('fast_hash', 'a.fast_hash').replace('file_size', 'a.file_size')}) THEN CASE WHEN a.id = s.source_id THEN 'SOURCE' ELSE 'COPY_' || s.source_id::VARCHAR END END AS duplicate_tag FROM active a LEFT JOIN {_SOURCE} s ON a.fast_hash = s.fast_hash AND a.file_size = s.file_size")
def _(t):
    return D.tagged(t.active).select("id", "duplicate_tag")


@query("h7_duplicate_ids", f"SELECT id FROM active a JOIN {FAMILIES} f ON a.fast_hash = f.fast_hash AND a.file_size = f.file_size WHERE {ELIGIBLE.replace('fast_hash', 'a.fast_hash').replace('file_size', 'a.file_size')}")
def _(t):
    return D.members(t.active).select("id")


@query("e1_old_by_creation", f"SELECT id FROM active WHERE {parse_creation('creation_time')} <= {AS_OF_SQL} - to_days(730)")
def _(t):
    return t.active.where(dates.parse_creation_time(F.col("creation_time")) <= dates.days_before(AS_OF, 730)).select("id")


@query("e2_stale", f"SELECT id, file_size FROM active WHERE {RELIABLE} <= {AS_OF_SQL} - to_days(365)")
def _(t):
    return M.stale(t.active, AS_OF, 365).select("id", "file_size")


@query("e3_files_of_alert", f"SELECT path, {ALERT3} AS category FROM judged WHERE ({ALERT3}) IS NOT NULL UNION ALL SELECT path, 'duplicates' FROM active a JOIN {FAMILIES} f ON a.fast_hash = f.fast_hash AND a.file_size = f.file_size WHERE {ELIGIBLE.replace('fast_hash', 'a.fast_hash').replace('file_size', 'a.file_size')}")
def _(t):
    alerts = M.alert_flags(t.judged).where("alert_3way is not null").select("path", F.col("alert_3way").alias("category"))
    return alerts.unionByName(D.members(t.active).select("path", F.lit("duplicates").alias("category")))


@query("e4_affected_files", f"SELECT path, {ALERT2} AS category FROM judged WHERE ({ALERT2}) IS NOT NULL")
def _(t):
    return M.alert_flags(t.judged).where("alert_2way is not null").select("path", F.col("alert_2way").alias("category"))


@query("u10_recommendations", f""", a AS (SELECT count(*) FILTER (({ALERT2}) = 'super_critical') AS s, count(*) FILTER (({ALERT2}) = 'critical') AS c FROM judged), d AS (SELECT {gb_sql('sum((n - 1) * file_size)')} AS w, count(*) AS g FROM {FAMILIES}),
z AS (SELECT {gb_sql('coalesce(sum(file_size) FILTER (file_size >= 104857600), 0) + coalesce(sum(file_size) FILTER (' + _DORMANT + '), 0)')} AS z, count(*) FILTER (file_size >= 104857600 OR {_DORMANT}) AS n FROM active), t AS (SELECT {gb_sql('sum(file_size)')} AS gb, count(*) AS n FROM active),
m AS (SELECT list_filter([CASE WHEN s > 0 THEN printf('URGENT: %d super critical files need action now', s) END, CASE WHEN c > 10 THEN printf('PRIORITY: %d critical files to treat soon', c) END, CASE WHEN w > 1 THEN printf('SPACE: %.1fGB wasted in %d groups of duplicates', w, g) END, CASE WHEN z.z > 5 THEN printf('ARCHIVE: %.1fGB in %d old or large files', z.z, z.n) END,
 CASE WHEN gb > 100 THEN 'CAPACITY: watch the disk space' END, CASE WHEN s > 0 OR c > 50 THEN 'SECURITY: audit the sensitive files' END, CASE WHEN t.n > 100000 THEN 'PERFORMANCE: consider an index for large volumes' END], lambda x: x IS NOT NULL)[1:5] AS l FROM a, d, z, t),
e AS (SELECT CASE WHEN len(l) = 0 THEN ['No particular recommendation'] ELSE l END AS l FROM m) SELECT CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(l) AS message FROM e""")
def _(t):
    two = M.alert_flags(t.judged).agg(F.count_if(F.col("alert_2way") == "super_critical").alias("super_critical"), F.count_if(F.col("alert_2way") == "critical").alias("critical"))
    waste = D.families(t.active).agg(M.gb(F.sum((F.col("n") - 1) * F.col("file_size"))).alias("wasted_gb"), F.count(F.lit(1)).alias("groups"))
    age = M.size_and_age(t.active, AS_OF).select(F.col("archival_size_gb").alias("archival_gb"), F.col("total_affected").alias("affected"))
    total = M.totals(t.active).select(F.col("total_size_gb").alias("total_gb"), "total_files")
    figures = two.join(F.broadcast(waste)).join(F.broadcast(age)).join(F.broadcast(total))
    return M.recommendations(figures)


del P
