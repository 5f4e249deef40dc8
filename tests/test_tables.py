"""Tables that change in place, deep pages, listing of a tree."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inventra.config import INVENTORY_COLUMNS
from inventra.operators import answers, pages, sinks, tables
from inventra.sources import inventory, listing


def _files(folder) -> dict[str, float]:
    """Data files of a table and when they were written."""
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def _inventory(path, numbers) -> str:
    lines = [",".join({"Name": f"n{i}.txt", "UNCDirectory": "/s", "FileSize": str(i)}.get(c, "x") for c in INVENTORY_COLUMNS) for i in numbers]
    path.write_text("\n".join([",".join(INVENTORY_COLUMNS), *lines]))
    return str(path)


def test_insert_or_ignore(spark, tmp_path):
    """A second ingest of a file adds nothing, one that overlaps adds the rest; no two rows share an id; partitions that can't hold a new path aren't read."""
    target = str(tmp_path / "t")
    first, second = _inventory(tmp_path / "a.csv", range(300)), _inventory(tmp_path / "b.csv", range(280, 320))
    assert [inventory.ingest(spark, p, target)["inserted"] for p in (first, first, second, second)] == [300, 0, 20, 0]
    rows = spark.read.parquet(target)
    assert rows.count() == rows.select("id").distinct().count() == rows.select("path").distinct().count() == 320
    one = spark.read.parquet(target).where(F.col("bucket").isin(tables.touched(rows.where("path = '/s/n7.txt'"))))
    plan = one.select("bucket", "path")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "ReadSchema: struct<path:string>" in plan
    met = tables.among(spark.read.parquet(target), spark.createDataFrame([("/s/n7.txt",), ("/none",)], "path string"), "path")
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString() and [r[0] for r in met.collect()] == ["/s/n7.txt"]


def test_ids(spark):
    """Ids of appends, partitions and rows never meet; what doesn't fit is an error."""
    made = [r[0] for n in (0, 1, 2) for r in spark.range(0, 1000, 1, 7).select(tables.ids(n)).collect()]
    assert len(set(made)) == 3000 and min(made) >= 0
    with pytest.raises(ValueError):
        tables.ids(1 << 15)


def test_update_touches_its_partitions(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("exclusion_reason"))
    target = str(tmp_path / "t")
    tables.create(rows, target, "path")
    before = _files(target)
    late = spark.createDataFrame([(5, "error", "late", 1), (5, "completed", None, 2), (77, "error", "late", 1), (99_999, "error", "none", 1)], "id long, status string, exclusion_reason string, seq int")
    assert tables.update(spark, target, late, sinks.with_status) == 2
    after = _files(target)
    changed = {f.split("/")[0] for f in before if before[f] != after.get(f)}
    assert len(changed) == 2 and {f.split("/")[0] for f in after} == {f.split("/")[0] for f in before}
    got = {r["id"]: (r["status"], r["exclusion_reason"]) for r in spark.read.parquet(target).collect()}
    assert len(got) == 2000 and got[5] == ("completed", None) and got[77] == ("error", "late") and got[6] == ("pending", None)
    assert tables.update(spark, target, late.where("id = 99999"), sinks.with_status) == 0


def test_replace(spark, tmp_path):
    moment = F.to_timestamp(F.lit("2024-01-01"))
    held = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("cache_key"), F.lit("old").alias("response_content"), moment.alias("created_at"), F.lit(7).alias("hits_count"))
    target = str(tmp_path / "t")
    tables.create(held, target, "cache_key")
    before = _files(target)
    new = spark.createDataFrame([("k3", "new"), ("fresh", "new")], "cache_key string, response_content string").withColumn("created_at", moment + F.expr("INTERVAL 1 DAY"))
    assert tables.replace(spark, target, new, "cache_key", lambda old, rows: answers.put(old, rows)) in (1, 2)
    got = {r["cache_key"]: (r["response_content"], r["hits_count"]) for r in spark.read.parquet(target).collect()}
    assert len(got) == 501 and got["k3"] == got["fresh"] == ("new", 1) and got["k4"] == ("old", 7)
    assert len({f.split("/")[0] for f in before if before[f] != _files(target).get(f)}) <= 2
    with pytest.raises(ValueError):
        tables.rewrite(spark, target, [0], lambda rows: rows.withColumn("bucket", F.lit(1)))


def test_deep_pages(spark, tmp_path):
    """Any page equals that of a sorted table, and one in the middle reads less than a fiftieth of the rows."""
    rows = spark.range(20_000).select("id", (F.col("id") * 7919 % 1009).alias("score"), F.lit("x").alias("name"))
    made = pages.build(rows, [F.col("score").desc(), F.col("id")], str(tmp_path / "p"), parts=128)
    want = [(r["id"], k) for k, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["id"])), 1)]
    again = pages.opened(spark, str(tmp_path / "p"))
    assert len(again) == 20_000 and again.index == made.index
    for limit, offset in ((50, 0), (50, 10_000), (700, 9_900), (50, 19_990), (5, 30_000)):
        got = sorted(((r["id"], r["row_number"]) for r in again.page(limit, offset).collect()), key=lambda x: x[1])
        assert got == want[offset : offset + limit]
    met = [n for _, before, n in again.index if before < 10_050 and before + n > 10_000]
    assert sum(met) < 400
    plan = again.page(50, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Sort" not in plan and "Exchange" not in plan
    assert dict((r["id"], r["row_number"]) for r in again.place(F.col("id").isin(5, 77)).collect()) == {i: k for i, k in want if i in (5, 77)}
    none = pages.build(rows.limit(0), [F.col("id")], str(tmp_path / "none"))
    assert len(none) == 0


def test_walk(spark, tmp_path):
    """Equal to a plain walk: hidden names, empty folders, depth, names with odd characters; links aren't followed."""
    root = tmp_path / "tree"
    for i, place in enumerate(("a.txt", "d/b.TXT", "d/e/f/c", ".hidden", "d/.x.y", "odd name, é.tar.gz", "many/1", "many/2", "many/3")):
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_bytes(b"x" * i)
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "d")
    want = {str(Path(d) / f): os.path.getsize(Path(d) / f) for d, _, names in os.walk(root) for f in names}
    for given in (str(root), f"file://{root}"):
        assert {r["path"]: r["size"] for r in listing.walk(spark, given).collect()} == want
    got = {r["name"]: r for r in listing.files(spark, str(root)).collect()}
    assert (got["b.TXT"]["extension"], got["c"]["extension"], got[".hidden"]["extension"], got["odd name, é.tar.gz"]["extension"]) == (".txt", "", "", ".gz")
    assert got[".hidden"]["file_attributes"] == "Hidden" and got["a.txt"]["owner"] and len(got["a.txt"]["last_modified"]) == 19
    assert [r["error"][:17] for r in listing.walk(spark, str(root / "none")).collect()] == ["FileNotFoundError"]
