"""Rules, duplicates, verdicts, cache and sinks on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from inventra.config import Rules
from inventra.functions import dates, text
from inventra.operators import answers, batch, duplicates, rules, sinks, verdicts

_FILES = "id long, path string, fast_hash string, file_size long, creation_time string, last_modified string, owner string, name string"


def _files(spark, rows):
    return spark.createDataFrame([(i, p, h, s, c, None, None, p) for i, p, h, s, c in rows], _FILES)


@pytest.mark.parametrize(
    ("changes", "reason"),
    [({}, "ok"), ({"extension": ".tmp"}, "blocked_extension"), ({"extension": "zip"}, "blocked_extension"), ({"extension": ".ZIP"}, "blocked_extension"), ({"file_size": 5}, "too_small"), ({"file_size": 1 << 30}, "too_large"), ({"file_attributes": "Hidden, System"}, "system_file"), ({"path": "/a/temp/b"}, "excluded_path")],
)
def test_rules(spark, changes, reason):
    row = {"path": "/share/documents/report.pdf", "extension": ".pdf", "file_size": 2000, "file_attributes": "", "file_signature": "pdf"} | changes
    df = spark.createDataFrame([tuple(row.values())], "path string, extension string, file_size long, file_attributes string, file_signature string")
    got = df.select(rules.exclusion_reason(Rules(excluded_paths=("*/temp/*",))), rules.priority_score(), rules.special_flags()).first()
    assert got[0] == reason
    if not changes:
        assert got[1] == 60 and got[2] == ["signature_mismatch"]


def test_duplicates(spark):
    files = _files(spark, [(1, "a", "h", 1, "02/01/2020 00:00:00"), (2, "b", "h", 1, "01/01/2020 00:00:00"), (3, "c", "x", 2, None), (4, "d", "z", 0, None), (5, "e", "z", 0, None), (6, "f.tmp", "ERROR1", 1, None)])
    assert duplicates.statistics(files).first().asDict() == {"families": 1, "files": 2, "sources": 1, "copies": 1, "wasted_bytes": 1, "wasted_mb": 0.0, "largest": 2, "mean_size": 2.0}
    tags = {r["id"]: r["duplicate_tag"] for r in duplicates.tagged(files).collect()}
    assert tags == {1: "COPY_2", 2: "SOURCE", 3: None, 4: None, 5: None, 6: None}
    reasons = {r[0]: r[1] for r in files.select("id", rules.ignore_reason()).collect()}
    assert reasons[4] == "zero_size_file" and reasons[6] == "hash_error"
    assert [r["id"] for r in duplicates.contiguous(duplicates.tagged(files)).collect()][:2] == [2, 1]
    assert duplicates.statistics(files.limit(0)).first()["families"] == 0


def test_pairs(spark):
    rows = [("a", 1, "a", 1, True), ("a", 1, "a", 2, False), ("a", 1, "b", 1, False), ("", 1, "", 1, False), (None, 1, None, 1, False), ("a", 0, "a", 0, True), ("a", -1, "a", -1, False), ("a", None, "a", None, False), ("a", 1 << 48, "a", 1 << 48, True), ("a", (1 << 48) + 1, "a", (1 << 48) + 1, False)]
    df = spark.createDataFrame(rows, "h1 string, s1 long, h2 string, s2 long, e boolean")
    assert df.where(text.is_duplicate_pair(F.col("h1"), F.col("s1"), F.col("h2"), F.col("s2")) != F.col("e")).count() == 0


def test_dates(spark):
    rows = ["2024-03-01 12:34:56", "2024-03-01 12:34:56.123", "2024-03-01", "1/3/2024 1:2:3", "01/03/2024", "1709294096", "30/02/2024", "later", None, ""]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(F.date_format(dates.parse_time(F.col("x")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-03-01 12:34:56", "2024-03-01 12:34:56", "2024-03-01 00:00:00", "2024-03-01 01:02:03", "2024-03-01 00:00:00", "2024-03-01 11:54:56", None, None, None, None]


def _interpreted(spark, content, status="completed"):
    return verdicts.interpret(spark.createDataFrame([(status, content)], "status string, content string")).first()


def test_interpretation(spark):
    four = {k: {"confidence": c} for k, c in zip(verdicts.DOMAIN_KEYS, (90, 80, 0, 70), strict=True)}
    assert _interpreted(spark, json.dumps(four))["confidence_global"] == 80
    got = _interpreted(spark, 'Sure: {"resume":"court","security":{"classification":"C1"}} done')
    assert (got["outcome"], got["resume"], got["verdict"]["security"]["classification"]) == ("completed", "court", "C1")
    assert _interpreted(spark, "notjson")["error"] == "Failed to extract JSON"
    assert _interpreted(spark, "")["error"] == "Empty content from API"
    assert _interpreted(spark, json.dumps({"resume": "word " * 60}))["outcome"] == "error"
    assert _interpreted(spark, json.dumps(four | {"parsing_error": True}))["error"] == "LLM parsing error"
    assert _interpreted(spark, json.dumps(four | {"resume": "Fichier inaccessible"}))["error"] == "File inaccessible to LLM"
    assert _interpreted(spark, "x", "failed")["outcome"] == "failed"
    assert len(_interpreted(spark, json.dumps(four | {"resume": "word " * 60}))["resume"].split()) == 50
    deep = 'see {"security": {"a": {"b": {"c": "}"}}}} end'
    assert json.loads(verdicts.salvage(deep)) == {"security": {"a": {"b": {"c": "}"}}}}
    assert verdicts.salvage('{"other": 1, "more": 2}') is None and verdicts.salvage('{"security": 5, "x": 1}') is None
    assert verdicts.salvage("{" * 20_000) is None


def test_cache(spark):
    now = "2024-06-01 00:00:00"
    cache = spark.sql("SELECT * FROM VALUES ('h_5_p', 'new', timestamp '2024-05-01', 3, timestamp '2024-07-01', 10L), ('g_p', 'old form', timestamp '2024-05-02', 1, timestamp '2024-07-01', 20L), ('k_5_p', 'gone', timestamp '2024-05-03', 1, timestamp '2024-05-04', 30L) t(cache_key, response_content, created_at, hits_count, ttl_expiry, file_size)")
    files = _files(spark, [(1, "a", "h", 5, None), (2, "b", "g", 5, None), (3, "c", "k", 5, None), (4, "d", "h", 0, None)]).withColumn("prompt_hash", F.lit("p"))
    assert {r["id"]: r["hit"] for r in answers.probe(files, cache, now).collect()} == {1: "key", 2: "legacy", 3: "miss", 4: "miss"}
    assert sorted(r[0] for r in answers.evict(cache, 15).select("cache_key").collect()) == ["h_5_p", "k_5_p"]
    new = spark.sql("SELECT 'h_5_p' AS cache_key, 'newer' AS response_content, timestamp '2024-05-31' AS created_at, timestamp '2024-07-31' AS ttl_expiry, 1L AS file_size")
    kept = {r["cache_key"]: (r["response_content"], r["hits_count"]) for r in answers.put(cache, new).collect()}
    assert kept["h_5_p"] == ("newer", 1) and len(kept) == 3


def test_batch(spark, data):
    from inventra.sources.bridge import Tables

    t = Tables(spark, data)
    empty = spark.createDataFrame([], "cache_key string, response_content string, ttl_expiry timestamp")
    files = t.files.where("status = 'pending'")
    got = batch.classify_files(files, empty, "2024-06-01 00:00:00")
    assert got.count() == files.count()
    assert {r[0] for r in got.select("outcome").distinct().collect()} == {"filtered", "completed"}


def test_sinks(spark, data, tmp_path):
    from inventra.sources.bridge import Tables

    t = Tables(spark, data)
    rows = sinks.flat(t.joined).select("id", "name", "security")
    sinks.to_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == rows.count()
    sinks.to_json(sinks.nested(t.joined), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("file_info.name").count() == rows.count()
    t.files.write.parquet(str(tmp_path / "files"))
    assert sinks.backup(spark, str(tmp_path / "files"), str(tmp_path / "copy")) == t.files.count()
    assert sinks.sound(spark, str(tmp_path / "copy")) == []
    assert json.loads(sinks.report({"rows": rows.limit(1)}, {"days": 1}))["parameters"] == {"days": 1}


def test_glob(spark):
    df = spark.createDataFrame([("/a/temp/b",), ("/a/b.tmp",), ("/x",)], "p string")
    assert [r[0] for r in df.select(text.glob(F.col("p"), "*/temp/*")).collect()] == [True, False, False]
