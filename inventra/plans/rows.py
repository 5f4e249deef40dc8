"""Registered row operators: views, expressions, rules, joins, pages and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, FINANCE_TYPES, GDPR_RISKS, LEGAL_TYPES, OTHER, SECURITY_CLASSES, Rules
from ..functions import dates
from ..functions import text as T
from ..operators import active as A
from ..operators import duplicates as D
from ..operators import paging as P
from ..operators import rules
from .base import ATTRIBUTES, ELIGIBLE, EXT, RELIABLE, SIZE_BUCKET, human_sql, parse_creation, parse_flexible, parse_time, period_sql, query

_ALIVE = "(status IS NULL OR status <> 'error')"
RULES = Rules(excluded_paths=("*/src3/*",))


@query("a12_active_files", "SELECT id, path, fast_hash, file_size, owner FROM active")
def _(t):
    return t.active.select("id", "path", "fast_hash", "file_size", "owner")


@query("a13_all_files", "SELECT id, path, coalesce(file_size, 0) AS file_size, status FROM files")
def _(t):
    return t.files.select("id", "path", F.coalesce("file_size", F.lit(0).cast("long")).alias("file_size"), "status")


@query("a16_log_levels", "SELECT CASE WHEN contains(line, ' [DEBUG] ') THEN 'DEBUG' WHEN contains(line, ' [WARNING] ') THEN 'WARNING' WHEN contains(line, ' [ERROR] ') THEN 'ERROR' WHEN contains(line, ' [CRITICAL] ') THEN 'CRITICAL' ELSE 'INFO' END AS level, count(*) AS n FROM (SELECT event_id::VARCHAR || CASE event_type WHEN 'view' THEN ' [DEBUG] ' WHEN 'error' THEN ' [ERROR] ' WHEN 'click' THEN ' [WARNING] ' ELSE ' [INFO] ' END || props AS line FROM events) GROUP BY 1", plain=True)
def _(t):
    tag = F.when(F.col("event_type") == "view", " [DEBUG] ").when(F.col("event_type") == "error", " [ERROR] ").when(F.col("event_type") == "click", " [WARNING] ").otherwise(" [INFO] ")
    return t.events.select(F.concat(F.col("event_id").cast("string"), tag, "props").alias("line")).groupBy(T.log_level(F.col("line")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("b1_metadata", "SELECT doc_id AS id, '/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/' END || lang AS path, '.' || lang AS extension, doc_id % 3 = 0 AS readable, coalesce(try_cast(trim(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE ' ' || n_chars::VARCHAR || ' ' END) AS BIGINT), 0) AS file_size FROM documents", plain=True)
def _(t):
    from ..sources import inventory

    raw = t.raw("documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")).alias("UNCDirectory"), F.col("lang").alias("Name"), F.concat(F.lit(".."), F.upper("lang")).alias("Extension"),
        F.when(F.col("doc_id") % 3 == 0, " TRUE ").otherwise("no").alias("Readable"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "))).alias("FileSize"),
    )
    return raw.select("id", inventory.full_path().alias("path"), T.extension(F.col("Extension")).alias("extension"), inventory.flag("Readable").alias("readable"), inventory.whole("FileSize").alias("file_size"))


_REASON = f"CASE WHEN {EXT} IN ('.tmp', '.log', '.bak', '.cache', '.zip') THEN 'blocked_extension' WHEN coalesce(file_size, 0) < 100 THEN 'too_small' WHEN coalesce(file_size, 0) > 104857600 THEN 'too_large' WHEN list_contains({ATTRIBUTES}, 'system') THEN 'system_file' WHEN path GLOB '*/src3/*' THEN 'excluded_path' ELSE 'ok' END"


@query("b2_exclusion", f"SELECT id, {_REASON} AS reason FROM files")
def _(t):
    return t.files.select("id", rules.exclusion_reason(RULES).alias("reason"))


@query("b3_priority", f"SELECT id, CAST(trunc(least(least(coalesce(file_size, 0)::DOUBLE / 104857600.0::DOUBLE, 1.0::DOUBLE) * 30 + CASE WHEN {EXT} IN ('.pdf', '.docx', '.doc', '.xlsx') THEN 40.0::DOUBLE WHEN {EXT} IN ('.txt', '.ini', '.cfg') THEN 12.0::DOUBLE ELSE 24.0::DOUBLE END + 20.0::DOUBLE + CASE WHEN list_contains({ATTRIBUTES}, 'hidden') THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN list_contains({ATTRIBUTES}, 'system') THEN 5.0::DOUBLE ELSE 0 END, 100.0::DOUBLE)) AS INTEGER) AS score FROM files")
def _(t):
    return t.files.select("id", rules.priority_score(RULES).alias("score"))


@query("b4_flags", f"SELECT id, array_to_string(list_filter([CASE WHEN list_contains({ATTRIBUTES}, 'hidden') THEN 'hidden_file' END, CASE WHEN list_contains({ATTRIBUTES}, 'system') THEN 'system_file' END, CASE WHEN coalesce(extension, '') <> '' AND coalesce(file_signature, '') <> '' AND NOT ends_with(lower(file_signature), lower(extension)) THEN 'signature_mismatch' END], lambda x: x IS NOT NULL), ',') AS flags, coalesce(file_signature <> '' AND NOT ends_with(lower(file_signature), replace(lower(extension), '.', '')), false) AS truly_mismatched FROM files")
def _(t):
    return t.files.select("id", F.array_join(rules.special_flags(), ",").alias("flags"), rules.true_signature_mismatch().alias("truly_mismatched"))


@query("b5_attributes", f"SELECT id, array_to_string({ATTRIBUTES}, '|') AS attributes FROM files")
def _(t):
    return t.files.select("id", F.array_join(T.attributes(F.col("file_attributes")), "|").alias("attributes"))


@query("b6_human_size", f"SELECT id, {human_sql('file_size')} AS spaced, {human_sql('file_size', '')} AS tight, CASE WHEN coalesce(file_size, 0) = 0 THEN '0B' ELSE {human_sql('file_size', '')} END AS zeroed FROM active")
def _(t):
    size = F.col("file_size")
    return t.active.select("id", T.human_size(size).alias("spaced"), T.human_size(size, "").alias("tight"), T.human_size(size, "", "0B").alias("zeroed"))


@query("b7_file_type", "SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'Unknown' ELSE CASE lower(string_split(name, '.')[-1]) WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOC' WHEN 'xlsx' THEN 'XLS' WHEN 'txt' THEN 'TXT' WHEN 'png' THEN 'IMG' ELSE 'Autres' END END AS kind FROM files")
def _(t):
    return t.files.select("id", T.file_type(F.col("name")).alias("kind"))


@query("b8_percentage", "SELECT status, printf('%.1f%%', 100.0::DOUBLE * count(*) / (SELECT count(*) FROM files)) AS share FROM files GROUP BY 1")
def _(t):
    return t.files.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(t.files.agg(F.count(F.lit(1)).alias("total")))).select("status", T.percentage(F.col("n"), F.col("total")).alias("share"))


@query("b9_truncated", "SELECT id, left(name, 50) AS name, left(path, 80) AS head, CASE WHEN length(path) > 10 THEN right(path, 10) ELSE path END AS tail, left(last_modified, 19) AS modified FROM files")
def _(t):
    return t.files.select("id", F.substring("name", 1, 50).alias("name"), F.substring("path", 1, 80).alias("head"), T.tail(F.col("path"), 10).alias("tail"), F.substring("last_modified", 1, 19).alias("modified"))


@query("b10_active_predicate", f"SELECT id, {_ALIVE} AS active FROM files")
def _(t):
    return t.files.select("id", A.is_active(F.col("status")).alias("active"))


@query("b11_grid_filter", "SELECT id, response_id, file_size FROM joined WHERE status = 'completed' AND security_class = 'C0'")
def _(t):
    return P.matching(t.joined, "completed", "C0").select("id", "response_id", "file_size")


@query("b12_whitelist", "SELECT id FROM files WHERE status = 'completed' AND extension = '.pdf'")
def _(t):
    return P.whitelisted(t.files, {"status": "completed", "extension": ".pdf", "name; --": "x"}).select("id")


for _level in SECURITY_CLASSES:
    query(f"b13_at_least_{_level.lower()}", f"SELECT id FROM judged WHERE security_class >= '{_level}'")(lambda t, k=_level: t.judged.where(P.at_least(k)).select("id"))


@query("b14_builder", f"SELECT id, name, path, file_size, owner, last_modified FROM joined WHERE {_ALIVE} AND coalesce(file_size, 0) >= 52428800 AND file_size < 104857600 AND rgpd_risk = 'critical'")
def _(t):
    return P.drill(t.joined, P.in_bucket("50-100MB") & P.category("rgpd_risk", "critical", GDPR_RISKS), sized=False)


@query("d_dates", f"SELECT id, strftime({parse_time('last_modified')}, '%Y-%m-%d %H:%M:%S') AS d1, strftime({parse_creation('creation_time')}, '%Y-%m-%d %H:%M:%S') AS d2, strftime({parse_flexible('creation_time')}, '%Y-%m-%d %H:%M:%S') AS d3, strftime({RELIABLE}, '%Y-%m-%d %H:%M:%S') AS d4, {RELIABLE} < timestamp '2024-06-01 00:00:00' - to_days(400) AS d5 FROM files")
def _(t):
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    modified, created = F.col("last_modified"), F.col("creation_time")
    return t.files.select("id", show(dates.parse_time(modified)).alias("d1"), show(dates.parse_creation_time(created)).alias("d2"), show(dates.parse_flexible(created)).alias("d3"), show(dates.reliable_time(modified, created)).alias("d4"), P.older(AS_OF, 400).alias("d5"))


@query("t1_strings", "SELECT id, lower(trim(name)) AS low, starts_with(path, '/src1') AS starts, ends_with(path, '.pdf') AS finishes, contains(path, 'en') AS inside, string_split(path, '/')[2] AS first_part, concat_ws('-', owner, extension) AS joined, substr(path, 2, 4) AS part FROM active")
def _(t):
    path = F.col("path")
    return t.active.select("id", F.lower(F.trim("name")).alias("low"), path.startswith("/src1").alias("starts"), path.endswith(".pdf").alias("finishes"), path.contains("en").alias("inside"), F.split(path, "/")[1].alias("first_part"), F.concat_ws("-", "owner", "extension").alias("joined"), F.substring(path, 2, 4).alias("part"))


@query("t2_glob", "SELECT id, path GLOB '/src1*_en.*' AS matches FROM files")
def _(t):
    return t.files.select("id", T.glob(F.col("path"), "/src1*_en.*").alias("matches"))


@query("t3_word_cap", "SELECT doc_id, CASE WHEN len(regexp_split_to_array(trim(text), '[ \\t\\n\\f\\r]+')) > 50 THEN array_to_string(regexp_split_to_array(trim(text), '[ \\t\\n\\f\\r]+')[1:50], ' ') ELSE text END AS resume FROM documents", plain=True)
def _(t):
    return t.raw("documents").select("doc_id", T.first_words(F.col("text"), 50).alias("resume"))


@query("t4_byte_size", "SELECT doc_id, strlen(text) AS n_bytes FROM documents", plain=True)
def _(t):
    return t.raw("documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("t5_md5", "SELECT doc_id, md5(text) AS md5 FROM documents", plain=True)
def _(t):
    return t.raw("documents").select("doc_id", F.md5("text").alias("md5"))


@query("t6_patterns", "SELECT event_id, regexp_matches(props, '[0-9]{2}') AS two_digits, len(regexp_extract_all(props, '[0-9]')) AS n_digits FROM events", plain=True)
def _(t):
    return t.events.select("event_id", F.col("props").rlike("[0-9]{2}").alias("two_digits"), F.size(F.regexp_extract_all("props", F.lit("[0-9]"), 0)).cast("long").alias("n_digits"))


@query("t7_classified", "SELECT id FROM joined WHERE security_class = 'C3'")
def _(t):
    return t.joined.where(F.get_json_object("security_analysis", "$.classification") == "C3").select("id")


@query("n1_json_extract", "SELECT id, json_extract_string(security_analysis, '$.classification') AS c, json_extract_string(rgpd_analysis, '$.risk_level') AS r, json_extract_string(finance_analysis, '$.document_type') AS f, json_extract_string(legal_analysis, '$.contract_type') AS l FROM responses")
def _(t):
    get = F.get_json_object
    return t.responses.select("id", get("security_analysis", "$.classification").alias("c"), get("rgpd_analysis", "$.risk_level").alias("r"), get("finance_analysis", "$.document_type").alias("f"), get("legal_analysis", "$.contract_type").alias("l"))


@query("n2_json_default", "SELECT id, coalesce(json_extract_string(finance_analysis, '$.document_type'), 'N/A') AS kind, coalesce(json_extract_string(finance_analysis, '$.missing'), 'N/A') AS missing FROM responses")
def _(t):
    return t.responses.select("id", F.coalesce(F.get_json_object("finance_analysis", "$.document_type"), F.lit("N/A")).alias("kind"), F.coalesce(F.get_json_object("finance_analysis", "$.missing"), F.lit("N/A")).alias("missing"))


@query("n3_to_json", "SELECT id, coalesce('{\"classification\":\"' || security_class || '\"}', 'null') AS j FROM responses")
def _(t):
    return t.responses.select("id", F.coalesce(F.when(F.col("security_class").isNotNull(), F.to_json(F.struct(F.col("security_class").alias("classification")))), F.lit("null")).alias("j"))


@query("x1_arithmetic", "SELECT id, least(greatest(file_size, 1000), 100000000) AS clamped, CAST(trunc(file_size / 3.0) AS BIGINT) AS cut, round(file_size::DOUBLE / 1048576, 2) AS mb, round(file_size::DOUBLE / 1073741824, 4) AS gb FROM active")
def _(t):
    size = F.col("file_size")
    return t.active.select("id", F.least(F.greatest(size, F.lit(1000)), F.lit(100_000_000)).alias("clamped"), (size / 3.0).cast("long").alias("cut"), F.round(size / float(1 << 20), 2).alias("mb"), F.round(size / float(1 << 30), 4).alias("gb"))


@query("x2_mean_deviation", "SELECT round(coalesce(avg(value), 0), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS deviation FROM events", plain=True)
def _(t):
    from ..operators import reliability

    return reliability.mean_and_deviation(t.events, "value")


@query("j1_all_responses", "SELECT id, response_id, file_size, security_class FROM joined")
def _(t):
    return t.joined.select("id", "response_id", "file_size", "security_class")


@query("j2_super_critical_join", "SELECT f.id FROM files f JOIN responses r ON f.id = r.fichier_id WHERE (status IS NULL OR status <> 'error') AND security_class = 'C3' AND rgpd_risk = 'critical'")
def _(t):
    return t.joined.where(A.is_active(F.col("status")) & F.col("response_id").isNotNull() & P.COMBINED["c3_critical"]()).select("id")


@query("j3_current_verdict", "SELECT fichier_id AS id, security_class, coalesce(rgpd_risk, 'none') AS rgpd_risk, legal_type FROM verdict")
def _(t):
    return A.current_verdicts(t.responses).select("id", "security_class", F.coalesce("rgpd_risk", F.lit("none")).alias("rgpd_risk"), "legal_type")


@query("j4_same_hash", "SELECT id FROM files WHERE fast_hash IN (SELECT fast_hash FROM files WHERE fast_hash IS NOT NULL AND fast_hash <> '' GROUP BY 1 HAVING count(*) > 1)")
def _(t):
    many = t.files.where("fast_hash <> ''").groupBy("fast_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return P.same_hash(t.files, many).select("id")


_GROUPS = "(SELECT id, fast_hash, file_size, count(*) OVER (PARTITION BY fast_hash, file_size) AS group_size FROM active WHERE coalesce(fast_hash, '') <> '')"


@query("j5_group_size", f"SELECT id, group_size FROM {_GROUPS}")
def _(t):
    return D.group_sizes(t.active).select("id", "group_size")


@query("j6_page_hashes", "SELECT id, fast_hash FROM files ORDER BY id DESC LIMIT 20")
def _(t):
    return t.files.orderBy(F.col("id").desc()).limit(20).select("id", "fast_hash")


@query("j7_duplicates_of_grid", f"SELECT id FROM joined WHERE id IN (SELECT id FROM {_GROUPS} WHERE group_size > 1) AND status = 'completed' ORDER BY id DESC, response_id DESC LIMIT 30")
def _(t):
    ids = D.group_sizes(t.active).where("group_size > 1").select("id")
    return P.page(P.matching(t.joined, "completed").join(ids, "id", "left_semi"), 30).select("id")


@query("l1_pending", "SELECT id, priority_score FROM files WHERE status = 'pending' AND priority_score >= 20 ORDER BY priority_score DESC, id LIMIT 25 OFFSET 5")
def _(t):
    return P.pending(t.files, 25, 20, 5).select("id", "priority_score")


@query("l2_page", "SELECT id, name, response_id, security_class FROM joined ORDER BY id DESC, response_id DESC NULLS LAST LIMIT 50 OFFSET 50")
def _(t):
    return P.page(t.joined, 50, 50).select("id", "name", "response_id", "security_class")


@query("l3_count", "SELECT count(*) AS n FROM joined WHERE status = 'completed' AND security_class = 'C1'")
def _(t):
    return P.matching(t.joined, "completed", "C1").agg(F.count(F.lit(1)).alias("n"))


@query("l4_keyset", "SELECT id, name FROM files WHERE id > 50 AND status = 'completed' ORDER BY id LIMIT 20")
def _(t):
    return P.keyset(t.files, 50, 20, {"status": "completed"}).select("id", "name")


@query("l5_duplicate_chunk", "SELECT id FROM files WHERE fast_hash IN (SELECT fast_hash FROM files WHERE fast_hash <> '' GROUP BY 1 HAVING count(*) > 1) ORDER BY id LIMIT 10 OFFSET 2")
def _(t):
    many = t.files.where("fast_hash <> ''").groupBy("fast_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return P.same_hash(t.files, many).orderBy("id").offset(2).limit(10).select("id")


@query("l7_jump", "SELECT count(*) FILTER (id > 77) AS rank, count(*) FILTER (id > 77) // 25 AS page, count(*) FILTER (id = 77) AS found FROM files")
def _(t):
    return P.position(t.files, 77, 25)


@query("l9_top_per_owner", "SELECT owner, id, file_size, CAST(row_number() OVER (PARTITION BY owner ORDER BY file_size DESC, id) AS INTEGER) AS rank FROM active QUALIFY rank <= 3")
def _(t):
    return P.last_first(t.active, [F.col("file_size").desc(), F.col("id")], 3, ["owner"]).select("owner", "id", "file_size", "rank")


_TAGGED = f"(SELECT a.id, a.creation_time, a.fast_hash, a.file_size, CASE WHEN ok AND source_id IS NOT NULL THEN CASE WHEN id = source_id THEN 'SOURCE' ELSE 'COPY_' || source_id::VARCHAR END END AS tag FROM (SELECT *, {ELIGIBLE} AS ok FROM active) a LEFT JOIN (SELECT fast_hash, file_size, first(id ORDER BY coalesce({parse_creation('creation_time')}, timestamp '9999-12-31'), id) AS source_id FROM active WHERE {ELIGIBLE} GROUP BY 1, 2 HAVING count(*) > 1) s USING (fast_hash, file_size))"


@query("l10_families_together", f"SELECT id, tag AS duplicate_tag, creation_time, CASE WHEN tag IS NOT NULL THEN max(id) OVER (PARTITION BY fast_hash, file_size, tag IS NOT NULL) END AS family_first FROM {_TAGGED}")
def _(t):
    return D.contiguous(D.tagged(t.active)).select("id", "duplicate_tag", "creation_time", "family_first")


@query("g9_copies_in_order", f"SELECT fast_hash, file_size, source_id, id, path, strftime({parse_creation('creation_time')}, '%Y-%m-%d %H:%M:%S') AS created FROM active JOIN (SELECT fast_hash, file_size, first(id ORDER BY coalesce({parse_creation('creation_time')}, timestamp '9999-12-31'), id) AS source_id FROM active WHERE {ELIGIBLE} GROUP BY 1, 2 HAVING count(*) > 1) s USING (fast_hash, file_size) WHERE {ELIGIBLE} AND id <> source_id")
def _(t):
    return D.copies(t.active).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query("g6_name_histogram", "SELECT count(*) AS copies, name FROM files GROUP BY name HAVING count(*) > 1")
def _(t):
    return D.name_histogram(t.files)


@query("l12_first_messages", "SELECT status, CAST(row_number() OVER (ORDER BY n DESC, status) AS INTEGER) AS rank FROM (SELECT coalesce(status, 'NULL') AS status, count(*) AS n FROM files GROUP BY 1) QUALIFY rank <= 2")
def _(t):
    from pyspark.sql import Window

    per = t.files.groupBy(F.coalesce("status", F.lit("NULL")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "status"))).where("rank <= 2").select("status", "rank")


@query("w1_large_or_old", f"SELECT id FROM active WHERE file_size >= 104857600 UNION SELECT id FROM active WHERE {RELIABLE} <= timestamp '2024-06-01 00:00:00' - to_days(365)")
def _(t):
    old = dates.reliable_time(F.col("last_modified"), F.col("creation_time")) <= dates.days_before(AS_OF, 365)
    return t.active.where((F.col("file_size") >= 104_857_600) | old).select("id")


@query("w2_critical_minus_super", "SELECT id FROM judged WHERE (security_class = 'C3' OR rgpd_risk = 'critical') EXCEPT SELECT id FROM judged WHERE security_class = 'C3' AND rgpd_risk = 'critical'")
def _(t):
    from ..operators.metrics import alert_flags

    return alert_flags(t.judged).where("alert_2way = 'critical'").select("id")


@query("w3_present_domains", "SELECT id, CAST((security_class IS NOT NULL)::INT + (rgpd_risk IS NOT NULL)::INT + (finance_type IS NOT NULL)::INT + (legal_type IS NOT NULL)::INT AS INTEGER) AS n FROM responses")
def _(t):
    present = F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in A.DOMAINS]))
    return t.responses.select("id", F.size(F.array_intersect(present, F.array(*[F.lit(d) for d in A.DOMAINS]))).alias("n"))


@query("w4_rank", "SELECT id, CAST(row_number() OVER (PARTITION BY owner ORDER BY id DESC) - 1 AS INTEGER) AS position FROM active")
def _(t):
    return P.positions(t.active.select("id", "owner"), ["owner"]).select("id", "position")


@query("w5_first_of_family", f"SELECT fast_hash, file_size, min(id) AS first_id FROM {_GROUPS} WHERE group_size > 1 GROUP BY 1, 2")
def _(t):
    return D.group_sizes(t.active).where("group_size > 1").groupBy("fast_hash", "file_size").agg(F.min("id").alias("first_id"))


def _drill(name: str, where: str, predicate, shown: str | None = None, sized: bool = True, more: str = "") -> None:
    verdict = f", coalesce({shown}, 'N/A') AS verdict" if shown else ""
    sql = f"{more}SELECT id, name, path, file_size, owner, last_modified{verdict} FROM joined WHERE {_ALIVE} AND ({where})" + (" AND file_size > 0" if sized else "")
    query(name, sql)(lambda t: P.drill(t.joined, predicate(), shown, sized))


for _prefix, _column, _known, _null in (("r1_security", "security_class", SECURITY_CLASSES, False), ("r2_rgpd", "rgpd_risk", GDPR_RISKS, True), ("r3_finance", "finance_type", FINANCE_TYPES, True), ("r4_legal", "legal_type", LEGAL_TYPES, True)):
    _names = ", ".join(f"'{k}'" for k in _known)
    for _value in (*_known, OTHER):
        if _value == OTHER:
            _where = f"{_column} IS NULL OR {_column} NOT IN ({_names})"
        elif _value == "none" and _null:
            _where = f"{_column} IS NULL OR {_column} = 'none'"
        else:
            _where = f"{_column} = '{_value}'"
        _drill(f"{_prefix}_{_value.lower()}", _where, lambda c=_column, v=_value, k=_known, n=_null: P.category(c, v, k, n), _column)

for _tag, _bucket in (("below_50", "<50MB"), ("50", "50-100MB"), ("100", "100-150MB"), ("150", "150-200MB"), ("200", "200-300MB"), ("300", "300-500MB"), ("above_500", ">500MB")):
    _drill(f"r5_size_{_tag}", f"({SIZE_BUCKET.replace('file_size', 'coalesce(file_size, 0)')}) = '{_bucket}'", lambda b=_bucket: P.in_bucket(b), sized=False)

for _days in (365, 1095):
    _drill(f"r6_older_{_days}_days", f"{RELIABLE} < timestamp '2024-06-01 00:00:00' - to_days({_days})", lambda d=_days: P.older(AS_OF, d))

for _field in ("last_modified", "creation_time"):
    for _age, _where in (
        ("recent_7_days", "m >= b - to_days(7)"), ("recent_30_days", "m >= b - to_days(30) AND m < b - to_days(7)"), ("recent_90_days", "m >= b - to_days(90) AND m < b - to_days(30)"),
        ("old_1_year", "m < b - to_years(1)"), ("old_2_years", "m < b - to_years(2)"), ("dormant", "m < b - to_days(500)"),
    ):
        query(f"r6_{_age}_{_field}", f"SELECT id, name, path, file_size, {_field}, owner, coalesce(security_class, 'none') AS classif, coalesce(rgpd_risk, 'none') AS rgpd FROM (SELECT *, {parse_time(_field)} AS m, timestamp '2024-06-01 00:00:00' AS b FROM joined) WHERE {_ALIVE} AND file_size > 0 AND {_where}")(lambda t, a=_age, f=_field: P.aged(t.joined, AS_OF, a, f, 500))

for _date, _pair in (("modification", ("last_modified", "creation_time")), ("creation", ("creation_time", "last_modified"))):
    for _period in ("0_1y", "1_2y", "2_3y", "3_4y", "4_5y", "5_6y", "6plus"):
        _moment = f"coalesce({parse_flexible(_pair[0])}, {parse_flexible(_pair[1])})"
        _drill(f"r8_{_date}_{_period}", f"({period_sql(_moment, False)}) = '{_period}'", lambda d=_date, p=_period: P.in_period(AS_OF, p, d))

for _kind, _where in (("c3_critical", "security_class = 'C3' AND rgpd_risk = 'critical'"), ("c3_legal", "security_class = 'C3' AND legal_type IN ('nda', 'litigation')"), ("c3_total", "security_class = 'C3'")):
    _drill(f"r9_{_kind}", _where, P.COMBINED[_kind], "security_class")

for _kind, _where in (("large", "file_size > 100000000"), ("c3", "security_class = 'C3'"), ("critical", "rgpd_risk = 'critical'"), ("all", "true")):
    _drill(f"r11_owner_{_kind}", f"owner = 'src1' AND {_where}", lambda k=_kind: P.of_owner("src1", k))


@query("r7_duplicate_groups", f"SELECT id, file_size, group_size FROM {_GROUPS} WHERE group_size > 1 AND file_size > 0")
def _(t):
    return D.group_sizes(t.active).where("group_size > 1 AND file_size > 0").orderBy(F.col("group_size").desc(), F.col("file_size").desc(), "id").select("id", "file_size", "group_size")


for _tag, _test in ((*((f"{k}x", f"group_size = {k}") for k in range(1, 7)), ("7x", "group_size >= 7"))):
    query(f"r10_level_{_tag}", f"SELECT id, file_size, group_size FROM {_GROUPS} WHERE {_test}")(lambda t, w=_test: D.group_sizes(t.active).where(w).select("id", "file_size", "group_size"))


@query("r12_details", "SELECT id, name, path, host, username, file_size, owner, status, response_id, resume FROM joined WHERE id = 21 ORDER BY response_id LIMIT 1")
def _(t):
    return t.joined.where("id = 21").orderBy("response_id").limit(1).select("id", "name", "path", "host", "username", "file_size", "owner", "status", "response_id", "resume")


@query("r14_diagnostic", "SELECT 'files' AS table_name, count(*) AS n FROM files UNION ALL SELECT 'responses', count(*) FROM responses")
def _(t):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
    return count(t.files, "files").unionByName(count(t.responses, "responses"))
