"""Registered verdict parsing, prompts, cache, reliability, sinks and the batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AS_OF, INVENTORY_COLUMNS
from ..operators import answers as C
from ..operators import batch, durable, pages, prompts, sinks, tables, verdicts
from ..operators import reliability as Q
from ..sources import inventory, listing, shared
from ..sources import logs as log_files
from ..streaming import answer_state, paced
from .base import ATTRIBUTES, EXT, confidence_sql, human_sql, query

_CONF = confidence_sql("security_confidence", "rgpd_confidence", "finance_confidence", "legal_confidence")


def calls(t) -> DataFrame:
    """A call log from the events: worker, duration, ok, ts."""
    return t.events.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("worker"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("ok"), "ts")


_CALLS = "(SELECT event_id AS call_id, user_id AS worker, value AS duration, event_type <> 'error' AS ok, ts FROM events)"


def cache(t) -> DataFrame:
    """An answer cache over the active files: every third key is of the older form, every seventh has expired."""
    rows = t.files.where("fast_hash is not null")
    key = F.when(F.col("id") % 3 == 0, C.legacy_key(F.col("fast_hash"), F.lit("p1"))).otherwise(C.key(F.col("fast_hash"), F.coalesce("file_size", F.lit(0)), F.lit("p1")))
    days = F.expr(f"timestamp '{AS_OF}' + make_dt_interval(CAST(if(id % 7 = 0, -1, 1) AS INT))")
    return rows.select(key.alias("cache_key"), F.concat(F.lit("answer "), F.col("id").cast("string")).alias("response_content"), F.expr(f"timestamp '{AS_OF}' - make_dt_interval(CAST(id % 50 AS INT), 0, 0, id / 100000)").alias("created_at"), (F.col("id") % 10 + 1).cast("int").alias("hits_count"), days.alias("ttl_expiry"), F.coalesce("file_size", F.lit(0)).alias("file_size"))


_CACHE = f", cache AS (SELECT CASE WHEN id % 3 = 0 THEN fast_hash || '_p1' ELSE fast_hash || '_' || coalesce(file_size, 0)::VARCHAR || '_p1' END AS cache_key, 'answer ' || id::VARCHAR AS response_content, timestamp '{AS_OF}' - to_days(CAST(id % 50 AS INTEGER)) - to_microseconds(CAST(id * 10 AS BIGINT)) AS created_at, CAST(id % 10 + 1 AS INTEGER) AS hits_count, timestamp '{AS_OF}' + to_days(CASE WHEN id % 7 = 0 THEN -1 ELSE 1 END) AS ttl_expiry, coalesce(file_size, 0) AS file_size FROM files WHERE fast_hash IS NOT NULL), latest AS (SELECT * FROM cache QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) = 1) "


def latest(t) -> DataFrame:
    return C.put(cache(t).limit(0), cache(t).drop("hits_count"))


_ASKED = "(SELECT fast_hash || '_' || file_size::VARCHAR || '_p1' AS k, fast_hash || '_p1' AS o FROM active WHERE (CASE WHEN coalesce(file_size, 0) = 0 THEN 'z' WHEN contains(upper(fast_hash), 'ERROR') THEN 'h' WHEN regexp_matches(lower(path), '(\\.tmp|\\.temp|\\.~)$') THEN 't' ELSE 'ok' END) = 'ok')"


@query("c1_cached_result", _CACHE + f", told AS (SELECT a.k, a.o, x.cache_key IS NOT NULL AS there, coalesce(x.ttl_expiry > timestamp '{AS_OF}', false) AS fresh FROM {_ASKED} a LEFT JOIN latest x ON a.k = x.cache_key), n AS (SELECT key, count(*) AS n FROM (SELECT k AS key FROM told WHERE there UNION ALL SELECT o FROM told WHERE NOT fresh) GROUP BY 1) SELECT cache_key, CAST(1 + coalesce(n, 0) AS INTEGER) AS hits_count FROM latest LEFT JOIN n ON cache_key = key WHERE n IS NULL OR ttl_expiry > timestamp '{AS_OF}'")
def _(t):
    return C.after_probe(t.active.withColumn("prompt_hash", F.lit("p1")), latest(t), AS_OF).select("cache_key", "hits_count")


@query("j8_cache_probe", _CACHE + f", live AS (SELECT * FROM latest WHERE ttl_expiry > timestamp '{AS_OF}') SELECT f.id, coalesce(a.response_content, b.response_content) AS answer, CASE WHEN a.cache_key IS NOT NULL THEN 'key' WHEN b.cache_key IS NOT NULL THEN 'legacy' ELSE 'miss' END AS hit FROM (SELECT *, (CASE WHEN coalesce(file_size, 0) = 0 THEN 'z' WHEN contains(upper(fast_hash), 'ERROR') THEN 'h' WHEN regexp_matches(lower(path), '(\\.tmp|\\.temp|\\.~)$') THEN 't' ELSE 'ok' END) = 'ok' AS fits FROM active) f LEFT JOIN live a ON fits AND f.fast_hash || '_' || f.file_size::VARCHAR || '_p1' = a.cache_key LEFT JOIN live b ON fits AND f.fast_hash || '_p1' = b.cache_key")
def _(t):
    return C.probe(t.active.withColumn("prompt_hash", F.lit("p1")), latest(t), AS_OF).select("id", "answer", "hit")


@query("c2_store", _CACHE + "SELECT cache_key, response_content, 1 AS hits_count FROM latest")
def _(t):
    return latest(t).select("cache_key", "response_content", "hits_count")


@query("c3_expired", _CACHE + f"SELECT cache_key FROM latest WHERE ttl_expiry <= timestamp '{AS_OF}'")
def _(t):
    return latest(t).where(F.col("ttl_expiry") <= F.to_timestamp(F.lit(AS_OF))).select("cache_key")


@query("c4_evict", _CACHE + "SELECT cache_key, hits_count, file_size FROM (SELECT *, coalesce(sum(file_size) OVER (ORDER BY hits_count, created_at, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cache) WHERE b >= 3000000000")
@query("w6_running_sum", _CACHE + "SELECT cache_key, hits_count, file_size FROM (SELECT *, coalesce(sum(file_size) OVER (ORDER BY hits_count, created_at, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cache) WHERE b >= 3000000000")
def _(t):
    return C.evict(cache(t), 3_000_000_000).select("cache_key", "hits_count", "file_size")


@query("g28_cache_statistics", _CACHE + "SELECT count(*) AS entries, round((sum(hits_count) - count(*)) * 100.0::DOUBLE / sum(hits_count), 2) AS hit_rate, strftime(min(created_at), '%Y-%m-%d') AS oldest, round(sum(file_size)::DOUBLE / 1048576, 4) AS size_mb, count(*) > 10000 AS cleanup_needed FROM cache")
def _(t):
    return C.statistics(cache(t)).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


@query("q1_call_metrics", f"SELECT count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors, round(avg(duration) FILTER (ok), 4) AS mean_duration, round(60 / avg(duration) FILTER (ok), 4) AS per_minute FROM {_CALLS}", plain=True)
def _(t):
    return Q.call_metrics(calls(t))


@query("q1_worker_metrics", f"SELECT worker, count(*) AS n_calls, count(*) FILTER (ok) AS successes, round(avg(duration), 4) AS mean_duration FROM {_CALLS} GROUP BY 1", plain=True)
def _(t):
    return Q.worker_metrics(calls(t))


for _name, _column in (("security", "security_class"), ("rgpd", "rgpd_risk")):
    query(f"q2_consistency_{_name}", f", k AS (SELECT {_column}, count(*) AS n FROM responses WHERE {_column} IS NOT NULL GROUP BY 1) SELECT round(100.0::DOUBLE * max(n) / sum(n), 4) AS consistency, round(100.0::DOUBLE - 100.0::DOUBLE * max(n) / sum(n), 4) AS variance, count(*) AS distinct_values, round(CASE WHEN sum(n) > 1 THEN least(count(*) * 100.0::DOUBLE / least(sum(n), 5), 100.0) ELSE 0 END, 4) AS spread FROM k")(lambda t, c=_column: Q.consistency(t.responses, c))


@query("q3_reliability_score", ", s AS (SELECT 100.0::DOUBLE * max(n) / sum(n) AS v FROM (SELECT count(*) AS n FROM responses WHERE security_class IS NOT NULL GROUP BY security_class)), r AS (SELECT 100.0::DOUBLE * max(n) / sum(n) AS v FROM (SELECT count(*) AS n FROM responses WHERE rgpd_risk IS NOT NULL GROUP BY rgpd_risk)), m AS (SELECT avg(security_confidence) AS mean, coalesce(stddev_samp(security_confidence), 0) AS dev FROM responses) SELECT round(0.4::DOUBLE * round(s.v, 4) + 0.4::DOUBLE * round(r.v, 4) + 0.2::DOUBLE * round(mean, 4) * (1 - least(round(dev, 4) / 100, 0.5::DOUBLE)), 2) AS score FROM s, r, m")
def _(t):
    one = Q.consistency(t.responses, "security_class").select(F.col("consistency").alias("s")).join(F.broadcast(Q.consistency(t.responses, "rgpd_risk").select(F.col("consistency").alias("r")))).join(F.broadcast(Q.mean_and_deviation(t.responses, "security_confidence")))
    return one.select(F.round(Q.score(F.col("s"), F.col("r"), F.col("mean"), F.col("deviation")), 2).alias("score"))


@query("q4_classification_spread", ", k AS (SELECT finance_type, count(*) AS n FROM responses WHERE finance_type IS NOT NULL GROUP BY 1) SELECT count(*) AS distinct_values, round(CASE WHEN sum(n) > 1 THEN least(count(*) * 100.0::DOUBLE / least(sum(n), 5), 100.0) ELSE 0 END, 4) AS spread FROM k")
def _(t):
    return Q.consistency(t.responses, "finance_type").select("distinct_values", "spread")


@query("q5_scalability", f"WITH w AS (SELECT min(m) AS lo FROM (SELECT round(avg(duration), 4) AS m FROM {_CALLS} GROUP BY worker)), x AS (SELECT 60 / lo AS most, (SELECT round(60 / avg(duration) FILTER (ok), 4) FROM {_CALLS}) AS rate FROM w) SELECT round(most, 4) AS most_per_minute, round(rate / most, 4) AS efficiency, CASE WHEN rate / most / 4 < 0.7 THEN 3 WHEN rate / most / 4 > 0.9 THEN 5 ELSE 4 END AS advised_workers, round(least(100.0, rate / 4 * 10), 4) AS score FROM x", plain=True)
def _(t):
    return Q.scalability(calls(t), workers=4)


for _name, _frame, _fun, _out in (("f1_moving_average", "9 PRECEDING", Q.moving_average, "avg(CAST(round(duration * 10000) AS BIGINT)) OVER w / 10000 AS moving"), ("w8_moving_average", "9 PRECEDING", Q.moving_average, "avg(CAST(round(duration * 10000) AS BIGINT)) OVER w / 10000 AS moving"), ("w9_running_mean", "UNBOUNDED PRECEDING", Q.running_mean, "avg(CAST(round(duration * 10000) AS BIGINT)) OVER w / 10000 AS running"), ("w7_running_max", "UNBOUNDED PRECEDING", Q.running_max, "max(duration) OVER w AS most"), ("f4_progress", "UNBOUNDED PRECEDING", Q.running_max, "max(duration) OVER w AS most")):
    query(_name, f"SELECT call_id, {_out} FROM {_CALLS} WINDOW w AS (PARTITION BY worker ORDER BY ts, call_id ROWS BETWEEN {_frame} AND CURRENT ROW)", plain=True)(lambda t, f=_fun, o=_out.split()[-1]: f(calls(t)).select("call_id", o))


@query("f5_progress_share", "SELECT count(*) FILTER (status IN ('completed', 'error')) AS finished, round(100.0::DOUBLE * count(*) FILTER (status IN ('completed', 'error')) / count(*), 2) AS percentage FROM files")
def _(t):
    done = F.count_if(F.col("status").isin("completed", "error"))
    return t.files.agg(done.alias("finished"), F.round(100.0 * done / F.count(F.lit(1)), 2).alias("percentage"))


def bodies(t) -> DataFrame:
    """Raw responses: verdicts in prose, nested, cut off, or none at all."""
    json = F.format_string('{"resume": "about %d", "security": {"classification": "%s", "confidence": %d}, "rgpd": {"risk_level": "low", "confidence": 40}}', F.col("id"), "security_class", "security_confidence")
    kind = F.col("id") % 6
    content = F.when(kind == 0, json).when(kind == 1, F.concat(F.lit("Here it is: "), json, F.lit(" thanks"))).when(kind == 2, F.substring(json, 1, 40)).when(kind == 3, "").when(kind == 4, '{"resume": "Fichier inaccessible", "security": {"classification": "N/A"}}').otherwise("no verdict at all here")
    return t.responses.select("id", F.when(F.col("id") % 13 == 0, "error").otherwise("completed").alias("status"), content.alias("content"))


@query("v1_interpret", ", b AS (SELECT *, id % 6 AS kind, id % 13 = 0 AS failed FROM responses) SELECT id, CASE WHEN failed THEN 'error' WHEN kind IN (0, 1) THEN 'completed' ELSE 'error' END AS outcome, CASE WHEN failed THEN NULL WHEN kind IN (2, 5) THEN 'Failed to extract JSON' WHEN kind = 3 THEN 'Empty content from API' WHEN kind = 4 THEN 'File inaccessible to LLM' END AS error, CASE WHEN NOT failed AND kind IN (0, 1) THEN security_class WHEN NOT failed AND kind = 4 THEN 'N/A' WHEN NOT failed AND kind IN (2, 5) THEN 'C0' END AS classification, CASE WHEN NOT failed AND kind IN (0, 1) THEN CASE WHEN security_confidence > 0 THEN (security_confidence + 40) // 2 ELSE 40 END ELSE 0 END AS confidence FROM b")
def _(t):
    rows = verdicts.interpret(bodies(t))
    return rows.select("id", "outcome", "error", F.col("verdict.security.classification").alias("classification"), F.col("confidence_global").alias("confidence"))


@query("v5_fallback", "SELECT turn, left(text, 500) AS resume, 'C0' AS classification, true AS parsing_error, conv_id FROM conversations WHERE role = 'assistant'", plain=True)
def _(t):
    rows = t.raw("conversations").where("role = 'assistant'").withColumn("v", verdicts.fallback(F.col("text")))
    return rows.select("conv_id", "turn", F.col("v.resume").alias("resume"), F.col("v.security.classification").alias("classification"), F.col("v.parsing_error").alias("parsing_error"))


@query("v6_confidences", f"SELECT id, {_CONF} AS confidence_global FROM responses")
def _(t):
    return verdicts.stored(t.responses).select("id", "confidence_global")


@query("v7_quality", ", b AS (SELECT id, trim(CASE id % 4 WHEN 0 THEN '{\"a\":1,\"b\":22}' WHEN 1 THEN 'x y z broken {' WHEN 2 THEN '{\"a\":' ELSE resume || '}' END) AS c, id % 5 = 0 AS e FROM responses), f AS (SELECT id, regexp_matches(c, '(?i)[a-z]\\s+[a-z]\\s+[a-z]') OR regexp_matches(c, '(?i)(?:mais|pour|avec)\\s+[a-z]{1,2}\\s+') AS k, c <> '' AND NOT ends_with(c, '}') AS t, e AS m, length(c) < 10 AS y FROM b) SELECT id, CASE WHEN y THEN 'empty_response' WHEN m THEN 'malformed_json' WHEN t THEN 'truncated' WHEN k THEN 'corrupted' ELSE 'success' END AS quality, array_to_string(list_filter([CASE WHEN k THEN 'french_text_corruption' END, CASE WHEN t THEN 'json_truncation' END, CASE WHEN m THEN 'json_syntax_error' END, CASE WHEN y THEN 'empty_content' END], lambda x: x IS NOT NULL), ',') AS issues FROM f")
def _(t):
    kind = F.col("id") % 4
    raw = F.when(kind == 0, '{"a":1,"b":22}').when(kind == 1, "x y z broken {").when(kind == 2, '{"a":').otherwise(F.concat("resume", F.lit("}")))
    bad = F.col("id") % 5 == 0
    state, issues = verdicts.quality(raw, F.when(bad, "error").otherwise("completed"), F.when(bad, "Failed to extract JSON"))
    return t.responses.select("id", state.alias("quality"), F.array_join(issues, ",").alias("issues"))


_PROMPT = f"'{prompts.SYSTEM}' || chr(10) || 'Name: ' || coalesce(name, '') || chr(10) || 'Size: ' || {human_sql('coalesce(file_size, 0)', '')} || chr(10) || 'Owner: ' || coalesce(owner, '') || chr(10) || 'Modified: ' || coalesce(last_modified, '') || chr(10) || 'Signature: ' || coalesce(file_signature, '')"


@query("u3_prompt", f"SELECT id, {_PROMPT} AS prompt FROM files")
def _(t):
    return t.files.select("id", prompts.build().alias("prompt"))


@query("u5_prompt_size", "SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) < 3500 THEN 'green' WHEN strlen(text) <= 3950 THEN 'orange' ELSE 'red' END AS colour, strlen(text) <= 4000 AS within FROM documents", plain=True)
def _(t):
    n = prompts.size(F.col("text"))
    return t.raw("documents").select("doc_id", n.cast("long").alias("n_bytes"), prompts.colour(n).alias("colour"), prompts.within(n).alias("within"))


_RULE = f"CASE WHEN {EXT} IN ('.tmp', '.log', '.bak', '.cache', '.zip') THEN 'blocked_extension' WHEN coalesce(file_size, 0) < 100 THEN 'too_small' WHEN coalesce(file_size, 0) > 104857600 THEN 'too_large' WHEN list_contains({ATTRIBUTES}, 'system') THEN 'system_file' ELSE 'ok' END"


@query("u6_batch_status", f"SELECT CASE WHEN ({_RULE}) = 'ok' THEN 'completed' ELSE 'filtered' END AS outcome, count(*) AS n FROM files WHERE status = 'pending' GROUP BY 1")
def _(t):
    done = batch.classify_files(t.files.where("status = 'pending'"), latest(t), AS_OF)
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _after(status: str) -> str:
    """Files and their new responses after a run over a status, by the offline classifier's formula."""
    told = f"status = '{status}' AND ({_RULE}) = 'ok'"
    return f"SELECT id, CASE WHEN {told} THEN 'completed' WHEN status = '{status}' THEN 'filtered' ELSE status END AS status, CASE WHEN status = '{status}' THEN nullif({_RULE}, 'ok') ELSE exclusion_reason END AS exclusion_reason, CASE WHEN {told} THEN 'C' || (length({_PROMPT}) % 4)::VARCHAR END AS classification FROM files"


def _shown(done: batch.Batch) -> DataFrame:
    told = done.responses.select(F.col("fichier_id").alias("id"), F.col("security_cached").alias("classification"))
    return done.files.select("id", "status", "exclusion_reason").join(told, "id", "left")


@query("u7_run_batch", _after("pending"))
def _(t):
    return _shown(batch.run_pending(t.files, latest(t), AS_OF, shared.folder(t.spark, "outcomes")))


@query("u8_run_errors", _after("error"))
def _(t):
    return _shown(batch.run_errors(t.files, latest(t), AS_OF, shared.folder(t.spark, "outcomes")))


@query("f7_resumed", _after("pending"))
def _(t):
    """A run that is stopped after each task's first portion, then goes on."""
    folder = shared.folder(t.spark, "outcomes")

    def stopping(texts):
        durable.stop(folder)
        return batch.offline(texts)

    batch.run_pending(t.files, latest(t), AS_OF, folder, classifier=stopping, sending=batch.Sending(bounds=durable.Bounds(rows=4)))
    return _shown(batch.resumed(t.files, latest(t), AS_OF, folder))


@query("u11_two_halves", _after("pending"))
def _(t):
    """Contents are posted in one stage and their results collected in another; the run then finds all answers."""
    folder, service = shared.folder(t.spark, "outcomes"), batch.OfflineService("offline://", "")
    once = batch.contents(batch.sorted_out(t.files.where("status = 'pending'"), latest(t), AS_OF)[2])
    batch.upload(once, folder, service)
    batch.collect_answers(t.spark, folder, service)
    return _shown(batch.run_pending(t.files, latest(t), AS_OF, folder))


@query("u12_paced_run", _after("pending"))
def _(t):
    """The pending contents in order of their scores, as a stream of batches of a fifth of them."""
    folder = shared.folder(t.spark, "outcomes")
    n = batch.contents(batch.sorted_out(t.files.where("status = 'pending'"), latest(t), AS_OF)[2]).count()
    return _shown(paced.run(t.files, latest(t), AS_OF, folder, max(1, -(-n // 5)))[0])


def documents_folder(t) -> str:
    """The documents' texts as files, in a folder by language and source, written where the rows are."""
    folder = shared.folder(t.spark, "tree")

    def put(batches):
        import pyarrow as pa

        system, root = shared.open_fs(folder)
        for rows in batches:
            for r in rows.to_pylist():
                place = f"{root}/{r['lang']}/{r['source']}"
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/{r['doc_id']}.txt") as out:
                    out.write((r["text"] or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([rows.num_rows], pa.int64())})

    t.raw("documents").select("doc_id", "lang", "source", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return folder


@query("a18_documents_sent", "SELECT doc_id AS id, 'completed' AS status, 'C' || (strlen(coalesce(text, '')) % 100 % 4)::VARCHAR AS classification FROM documents", plain=True)
def _(t):
    """The job reads each document from its file and sends it with the prompt; the answer depends on what was sent."""
    folder = documents_folder(t)
    path = F.concat_ws("/", F.lit(folder), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    none = F.lit(None).cast("string")
    files = t.raw("documents").select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), path.alias("path"), F.lit(".txt").alias("extension"), F.lit(1000).cast("long").alias("file_size"), F.col("source").alias("owner"), none.alias("fast_hash"), none.alias("file_attributes"), none.alias("file_signature"), none.alias("last_modified"), F.lit("pending").alias("status"), none.alias("exclusion_reason"), F.lit(1).alias("priority_score"))
    done = batch.run_pending(files, latest(t), AS_OF, shared.folder(t.spark, "outcomes"), classifier=batch.by_document, sending=batch.Sending(documents=True))
    return _shown(done).select("id", "status", "classification")


@query("b15_listing", "SELECT doc_id || '.txt' AS name, coalesce(lang, 'None') || '/' || coalesce(source, 'None') AS folder, '.txt' AS extension, strlen(coalesce(text, '')) AS file_size, 'pending' AS status, true AS dated FROM documents", plain=True)
def _(t):
    folder = documents_folder(t)
    parts = F.split("path", "/")
    found = listing.files(t.spark, folder)
    return found.select("name", F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2)).alias("folder"), "extension", "file_size", "status", F.col("last_modified").isNotNull().alias("dated"))


@query("v3_objects", "SELECT doc_id AS id, 'C' || (doc_id % 4)::VARCHAR AS classification FROM documents", plain=True)
def _(t):
    """Verdicts behind openings that never close, with braces and quotes in their strings, and nested ones."""
    text = F.translate(F.col("text"), '"\\{}\n\r\t', "       ")
    told = F.concat(F.lit('{"finance": {"amounts": [{"value": "} \\" {", "context": "'), F.substring(text, 1, 200), F.lit('"}]}, "security": {"classification": "C'), (F.col("doc_id") % 4).cast("string"), F.lit('"}}'))
    content = F.concat(F.repeat(F.lit('{"a": ['), (F.col("doc_id") % 50).cast("int")), F.lit(" {'no'} "), text, told, F.lit("} so much for that"))
    rows = verdicts.with_json(t.raw("documents").select(F.col("doc_id").alias("id"), content.alias("content")), F.col("content"), "json")
    return rows.select("id", F.get_json_object("json", "$.security.classification").alias("classification"))


@query("v4_valid", "SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'C1' WHEN 4 THEN 'C2' END AS classification FROM documents", plain=True)
def _(t):
    """An object is a verdict if it has a domain, and each domain that it has is an object."""
    text, kind = F.translate(F.col("text"), '"\\{}\n\r\t', "       "), F.col("doc_id") % 6
    given = {0: '"security": {"classification": "C1"}, "legal": {}', 1: '"security": {"classification": "C1"}, "legal": 3', 2: '"other": {"security": {"classification": "C1"}}', 3: '"security": ["C1"]', 4: '"rgpd": {}, "security": {"classification": "C2"}'}
    content = F.lit("[]")
    for k, told in given.items():
        content = F.when(kind == k, F.concat(F.lit('{"resume": "'), text, F.lit(f'", {told}}}'))).otherwise(content)
    rows = verdicts.with_json(t.raw("documents").select(F.col("doc_id").alias("id"), content.alias("content")), F.col("content"), "json")
    return rows.select("id", F.get_json_object("json", "$.security.classification").alias("classification"))


@query("a11_preview", "SELECT 'n, ' || doc_id || '\".txt' AS \"Name\", n_chars::VARCHAR AS \"FileSize\", CASE WHEN doc_id % 5 = 0 THEN 'file.pdfyz' ELSE 'file.pdf' END AS \"FileSignature\" FROM documents ORDER BY doc_id LIMIT 10", plain=True)
def _(t):
    return inventory.head(t.spark, inventory_csv(t, True), 10).select("Name", "FileSize", "FileSignature")


@query("k12_repaired", "SELECT id, path, CASE WHEN id % 3 = 0 THEN 'pending' ELSE status END AS status, greatest(CASE WHEN id % 7 = 0 THEN -1 ELSE file_size END, 0) AS file_size FROM files")
def _(t):
    """Statuses and sizes put right, and of two rows with an id the one that comes first."""
    hurt = t.files.select("id", "path", F.when(F.col("id") % 3 == 0, "odd").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("file_size")).cast("long").alias("file_size"))
    return sinks.repaired(hurt.unionByName(hurt.withColumn("path", F.concat("path", F.lit("~")))))


@query("a16_incremental_log", "SELECT CASE WHEN event_type IN ('error', 'ERROR') THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_type IN ('error', 'ERROR') THEN '2024 [ERROR] ' ELSE '2024 [INFO] ' END || event_type || ' ' || event_id::VARCHAR AS line FROM events", plain=True)
def _(t):
    """A log a worker that grows twice between readings of the stream, which goes on from its checkpoint; each line once."""
    folder, out = shared.folder(t.spark, "logs"), shared.folder(t.spark, "lines")
    line = F.concat(F.lit("2024 ["), F.when(F.col("event_type").isin("error", "ERROR"), "ERROR").otherwise("INFO"), F.lit("] "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    rows = t.events.select((F.col("user_id") % 16).alias("worker"), "event_id", line.alias("line"))
    bounds = rows.agg(F.percentile_approx("event_id", [0.4, 0.7, 1.0], 1000)).first()[0] or [0]
    for bound in bounds:
        _grown(rows.where(F.col("event_id") <= bound), folder)
        given = log_files.stream(t.spark, folder).select("level", "line")
        given.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("level string, line string").parquet(out)


def _grown(rows: DataFrame, folder: str) -> None:
    """Writes each worker's lines, in order, over its log: the file stays, and what was in it stays in front."""

    def put(batches):
        import pyarrow as pa

        system, root = shared.open_fs(folder)
        system.create_dir(root, recursive=True)
        worker, out = None, None
        for rows in batches:
            for w, line in zip(rows.column("worker").to_pylist(), rows.column("line").to_pylist(), strict=True):
                if w != worker:
                    if out is not None:
                        out.close()
                    worker, out = w, system.open_output_stream(f"{root}/worker-{w}.log")
                out.write(line.encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int64())})

    rows.repartition("worker").sortWithinPartitions("worker", "event_id").select("worker", "line").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _answer_events(t) -> DataFrame:
    """Answers and questions over the events: every fourth one of a user puts an answer, the others ask."""
    put = F.col("event_id") % 4 == 0
    return t.events.select("event_id", F.col("user_id").cast("string").alias("cache_key"), F.when(put, "put").otherwise("ask").alias("kind"), F.when(put, F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("answer"), F.col("ts").cast("timestamp").alias("at"))


@query("c1_answer_state", "WITH e AS (SELECT event_id, user_id::VARCHAR AS k, event_id % 4 = 0 AS put, ts::TIMESTAMP AS moment FROM events), p AS (SELECT *, lead(moment) OVER (PARTITION BY k ORDER BY moment, event_id) AS until FROM e WHERE put), m AS (SELECT a.event_id, a.moment, p.event_id AS source, p.moment AS since FROM e a LEFT JOIN p ON a.k = p.k AND p.moment <= a.moment AND (p.until IS NULL OR p.until > a.moment) AND a.moment < p.moment + to_hours(24) WHERE NOT a.put) SELECT event_id, source IS NOT NULL AS hit, 'answer ' || source::VARCHAR AS answer, CASE WHEN source IS NOT NULL THEN CAST(1 + row_number() OVER (PARTITION BY source ORDER BY moment, event_id) AS INTEGER) END AS hits FROM m", plain=True)
def _(t):
    """Answers live for a day from when they were put."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = shared.folder(t.spark, "asked"), shared.folder(t.spark, "answered")
    events = _answer_events(t)
    events.write.parquet(folder)
    given = answer_state.answered(t.spark.readStream.schema(events.schema).parquet(folder), 24)
    given.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(answer_state.OUT).parquet(out).select("event_id", "hit", "answer", "hits")


@query("k7_listing", "SELECT name AS \"Nom\", path AS \"Chemin\", file_size AS \"Taille\", owner AS \"Propriétaire\", last_modified AS \"Modifié\", coalesce(security_class, 'none') AS \"Classification\", coalesce(rgpd_risk, 'none') AS \"Risque RGPD\" FROM joined")
def _(t):
    return sinks.listing(t.joined)


@query("k8_results_table", f"SELECT id AS \"ID\", path AS \"File Path\", status AS \"Status\", coalesce(security_class, 'N/A') AS \"Security\", coalesce(rgpd_risk, 'N/A') AS \"RGPD\", coalesce(finance_type, 'N/A') AS \"Finance\", coalesce(legal_type, 'N/A') AS \"Legal\", {_CONF} AS \"Confidence\", processing_time_ms AS \"Processing Time\" FROM joined")
def _(t):
    return sinks.results_table(t.joined)


@query("k10_call_table", "SELECT event_id AS iteration, user_id AS worker_id, event_type AS status, 'success' AS quality_status, value AS api_duration, value * 2 AS total_duration, CAST(strlen(props) AS INTEGER) AS response_size, md5('p') AS prompt_hash, md5(props) AS response_hash, 'a;b' AS issues FROM events", plain=True)
def _(t):
    lit = F.lit
    return sinks.call_table(t.events.select(F.col("event_id").alias("iteration"), F.col("user_id").alias("worker_id"), F.col("event_type").alias("status"), lit("success").alias("quality_status"), F.col("value").alias("api_duration"), (F.col("value") * 2).alias("total_duration"), F.col("props").alias("raw_response"), lit("p").alias("prompt"), F.array(lit("a"), lit("b")).alias("issues")))


@query("v2_salvaged", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' END AS classification FROM documents", plain=True)
def _(t):
    """Verdicts in prose of any length: after braces that hold no JSON, after an object that is no verdict, and none."""
    text, kind = F.col("text"), F.col("doc_id") % 3
    content = F.when(kind == 0, F.concat(F.lit("note {x} "), text, F.lit(' {"security": {"classification": "C1"}} '), text)).when(kind == 1, F.concat(F.lit('{"a": {"b": 1}} '), F.repeat(text, 40), F.lit('{"security": {"classification": "C2"}}'))).otherwise(F.concat(F.lit("{ none "), text))
    rows = verdicts.with_json(t.raw("documents").select(F.col("doc_id").alias("id"), content.alias("content")), F.col("content"), "json")
    return rows.select("id", F.get_json_object("json", "$.security.classification").alias("classification"))


def inventory_csv(t, quoted: bool) -> str:
    """An inventory file written from the documents, a line in five with a stray quote; its folder."""
    quote = (lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))) if quoted else (lambda c: c)
    given = {"Name": F.concat(F.lit("n, "), F.col("doc_id").cast("string"), F.lit('".txt')) if quoted else F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".txt")), "Extension": F.lit("PDF"), "UNCDirectory": F.lit("/share"), "Readable": F.lit("True"), "FileSize": F.col("n_chars").cast("string"), "FileAttributes": F.lit("Hidden"), "FastHash": F.substring(F.md5("text"), 1, 16), "FileSignature": F.lit("file.pdf")}
    fields = [quote(given[c]) if i in inventory.QUOTED and c in given else given.get(c, F.lit("x")) for i, c in enumerate(INVENTORY_COLUMNS)]
    line = F.concat_ws(",", *fields)
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(line, F.lit('y"z"'))).otherwise(line)
    folder = shared.folder(t.spark, "inventory")
    t.raw("documents").select(F.struct(F.lit(0).alias("o"), "doc_id").alias("o"), line.alias("value")).repartitionByRange(3, "o").sortWithinPartitions("o").select("value").write.option("header", True).option("quote", "\u0000").option("escape", "\u0000").option("sep", "\u0001").csv(folder)
    return folder


@query("a8_ingest", "SELECT '/share/n, ' || doc_id || '\".txt' AS path, '.pdf' AS extension, n_chars AS file_size, 'pending' AS status, CASE WHEN n_chars < 100 THEN 'too_small' END AS exclusion_reason, CAST(trunc(least(n_chars::DOUBLE / 104857600.0::DOUBLE, 1.0::DOUBLE) * 30 + 65.0::DOUBLE) AS INTEGER) AS priority_score, 'hidden_file' AS flags, CASE WHEN doc_id % 5 = 0 THEN 'file.pdfyz' ELSE 'file.pdf' END AS file_signature FROM documents", plain=True)
def _(t):
    target = shared.folder(t.spark, "files")
    inventory.ingest(t.spark, inventory_csv(t, True), target)
    return t.spark.read.parquet(target).select("path", "extension", "file_size", "status", "exclusion_reason", "priority_score", F.array_join(F.array_except("special_flags", F.array(F.lit("signature_mismatch"))), ",").alias("flags"), "file_signature")


@query("a10_insert_or_ignore", "SELECT '/share/n, ' || doc_id || '\".txt' AS path, 'pending' AS status, 1 AS copies FROM documents", plain=True)
def _(t):
    """The same inventory twice: the second adds nothing; ids are each row's own."""
    target, given = shared.folder(t.spark, "files"), inventory_csv(t, True)
    for _ in range(2):
        inventory.ingest(t.spark, given, target)
    rows = t.spark.read.parquet(target)
    return rows.groupBy("id").agg(F.first("path").alias("path"), F.first("status").alias("status"), F.count(F.lit(1)).cast("int").alias("copies")).drop("id")


@query("k2_partition_update", "SELECT id, CASE WHEN id % 50 = 0 THEN 'error' ELSE status END AS status, CASE WHEN id % 50 = 0 THEN 'late' ELSE exclusion_reason END AS exclusion_reason FROM files")
def _(t):
    """Statuses are updated in a stored table; partitions without an update keep their files."""
    folder = shared.folder(t.spark, "files")
    tables.create(t.files, folder, "path")
    late = t.files.where("id % 50 = 0").select("id", F.lit("error").alias("status"), F.lit("late").alias("exclusion_reason"), F.lit(1).alias("seq"))
    tables.update(t.spark, folder, late, sinks.with_status)
    return t.spark.read.parquet(folder).select("id", "status", "exclusion_reason")


@query("c2_replaced", _CACHE + "SELECT cache_key, CASE WHEN hits_count = 3 THEN 'new' ELSE response_content END AS response_content, CASE WHEN hits_count = 3 THEN 1 ELSE hits_count END AS hits_count FROM latest")
def _(t):
    """Answers are put into a stored cache; only the partitions of their keys are written."""
    folder, held = shared.folder(t.spark, "cache"), C.put(cache(t).limit(0), cache(t).drop("hits_count")).drop("hits_count")
    held = held.join(cache(t).select("cache_key", "created_at", "hits_count"), ["cache_key", "created_at"])
    tables.create(held, folder, "cache_key")
    new = held.where("hits_count = 3").drop("hits_count").withColumns({"response_content": F.lit("new"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    tables.replace(t.spark, folder, new, "cache_key", lambda old, rows: C.put(old, rows))
    return t.spark.read.parquet(folder).select("cache_key", "response_content", "hits_count")


@query("l2_deep_page", "SELECT row_number, id, name, response_id, security_class FROM (SELECT *, row_number() OVER (ORDER BY id DESC, response_id DESC NULLS LAST) AS row_number, count(*) OVER () AS n FROM joined) WHERE row_number > n // 2 AND row_number <= n // 2 + 50")
def _(t):
    """The page of 50 rows in the middle of the grid, from files in the grid's order."""
    shown = t.joined.select("id", "name", "response_id", "security_class")
    made = pages.build(shown, [F.col("id").desc(), F.col("response_id").desc_nulls_last()], shared.folder(t.spark, "pages"))
    return made.page(50, len(made) // 2).select("row_number", "id", "name", "response_id", "security_class")


@query("l7_deep_jump", "SELECT id, row_number FROM (SELECT id, row_number() OVER (ORDER BY priority_score DESC, id) AS row_number FROM files) WHERE id % 100 = 77")
def _(t):
    """Places of files in the order in which they are worked on."""
    made = pages.build(t.files.select("id", "priority_score"), [F.col("priority_score").desc(), F.col("id")], shared.folder(t.spark, "pages"))
    return made.place(F.col("id") % 100 == 77).select("id", "row_number")


@query("a2_strict_lines", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'DirectoryType must not be quoted' ELSE '2 fields instead of 19' END AS faults FROM documents", plain=True)
def _(t):
    good = [f'"{c}"' if i in {*range(6), 12, *range(15, 19)} else c for i, c in enumerate(INVENTORY_COLUMNS)]
    bad = [f'"{c}"' if i == 11 else c for i, c in enumerate(good)]
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, ",".join(good)).when(kind == 1, ",".join(bad)).otherwise("a,b")
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.array_join(inventory.faults(line), "; ").alias("faults"))


@query("a1_scan_fields", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'a|b' || lang || '|' WHEN 1 THEN 'q\"' || lang || ',x|2' WHEN 2 THEN 'ab,' || lang || 'c|d' ELSE '' END AS fields FROM documents", plain=True)
def _(t):
    kind, lang = F.col("doc_id") % 4, F.col("lang")
    line = F.when(kind == 0, F.concat(F.lit("a,b"), lang, F.lit(","))).when(kind == 1, F.concat(F.lit('"q""'), lang, F.lit(',x",2'))).when(kind == 2, F.concat(F.lit('a"b,'), lang, F.lit('"c,d'))).otherwise("   ")
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.array_join(inventory.scan_fields(line), "|").alias("fields"))


@query("a15_tail", "SELECT event_type || event_id::VARCHAR AS line FROM events ORDER BY event_id DESC LIMIT 7", plain=True)
def _(t):
    folder = shared.folder(t.spark, "log")
    t.events.orderBy("event_id").select(F.concat("event_type", F.col("event_id").cast("string")).alias("value")).coalesce(1).write.text(folder)
    return inventory.tail(t.spark, folder, 7)


@query("k1_stored_response", f"SELECT id, security_class AS security_cached, rgpd_risk AS rgpd_cached, finance_type AS finance_cached, legal_type AS legal_cached, {_CONF} AS confidence_global FROM responses")
def _(t):
    return verdicts.stored(t.responses).select("id", "security_cached", "rgpd_cached", "finance_cached", "legal_cached", "confidence_global")


@query("k2_status_update", "SELECT id, CASE WHEN id % 6 = 0 THEN 'completed' WHEN id % 10 = 0 THEN 'error' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 10 = 0 THEN 'late' ELSE exclusion_reason END AS exclusion_reason FROM files")
def _(t):
    one = t.files.where("id % 10 = 0").select("id", F.lit("error").alias("status"), F.lit("late").alias("exclusion_reason"), F.lit(1).alias("seq"))
    two = t.files.where("id % 6 = 0").select("id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("exclusion_reason"), F.lit(2).alias("seq"))
    return sinks.with_status(t.files, one.unionByName(two)).select("id", "status", "exclusion_reason")


@query("k3_export_rows", "SELECT id, name, status, file_size, security_class FROM joined WHERE status = 'completed' AND security_class = 'C2'")
def _(t):
    return sinks.export_rows(t.joined, "completed", "C2").select("id", "name", "status", "file_size", "security_class")


@query("k4_export_flat", "SELECT id, coalesce(security_class, 'N/A') AS security, coalesce(rgpd_risk, 'N/A') AS rgpd, coalesce(finance_type, 'N/A') AS finance, coalesce(legal_type, 'N/A') AS legal FROM joined")
def _(t):
    return sinks.flat(t.joined).select("id", "security", "rgpd", "finance", "legal")


@query("k6_export_statistics", f", c AS (SELECT *, {_CONF} AS g FROM joined) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS error, round(coalesce(avg(g) FILTER (g > 0), 0), 4) AS mean_confidence, count(*) FILTER (security_class = 'C0') AS c0, count(*) FILTER (security_class = 'C1') AS c1, count(*) FILTER (security_class = 'C2') AS c2, count(*) FILTER (security_class = 'C3') AS c3 FROM c")
def _(t):
    return sinks.export_statistics(t.joined)


@query("k5_nested_rows", "SELECT id, name AS file_name, owner AS file_owner, status AS file_status, fast_hash AS file_hash, coalesce(security_class, 'N/A') AS security, coalesce(legal_type, 'N/A') AS legal, resume, processing_time_ms FROM joined")
def _(t):
    rows = sinks.nested(t.joined)
    info, told = F.col("file_info"), F.col("analysis")
    return rows.select("id", info["name"].alias("file_name"), info["owner"].alias("file_owner"), info["status"].alias("file_status"), info["fast_hash"].alias("file_hash"), told["security"].alias("security"), told["legal"].alias("legal"), told["resume"].alias("resume"), told["processing_time_ms"].alias("processing_time_ms"))
