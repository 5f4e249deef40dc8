"""Operators 8, 9 and 10 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from inventra.llm import common, exact_dedup, graph, imatch, near_dedup

from .conftest import SCHEMA, rows


def _set(text, width):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def _components(docs, width):
    sets = [(i, _set(t, width)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}  # rows that share a doc_id are one node

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(k)
    return {i: find(i) for i in root}


def _check_near(docs, width):
    got = near_dedup.near_duplicates(docs, width).collect()
    pairs = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want = _components(pairs, width)
    assert len(got) == len(pairs)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(_set(t, width))) for i, t in pairs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("width", [2, 5])
def test_near_odd(odd, width):
    _check_near(odd, width)


def test_near_documents(documents):
    _check_near(documents, 2)


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty, 2).count() == 0


@pytest.mark.parametrize("sizes", [(16, 8, 500), (8192, 4096, 2 << 20)])
def test_near_common_passage(spark, monkeypatch, sizes):
    """Documents around a long common passage, at similarities around the limit, in blocks of a few and in one."""
    for name, size in zip(("BLOCK", "LINK_BLOCK", "LINK_SHINGLES"), sizes, strict=True):
        monkeypatch.setattr(near_dedup, name, size)
    passage = " ".join(f"p{i}" for i in range(90))
    made = [(i, passage + " " + " ".join(f"d{i % 40}w{j}" for j in range(4 + i % 14)), None) for i in range(160)]
    docs = spark.createDataFrame(made, "doc_id long, text string, extra string")
    _check_near(docs, 2)


def test_near_planted(spark):
    """A large group of copies with edits at random places (similarities of 0.5 to 1 to one another), at five words."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    made = [(7 * i + 1, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0.003, 0.01, 0.03]) else w for w in base)) for i in range(300)]
    made += [(7 * i + 3, " ".join(f"z{rng.randrange(4000)}" for _ in range(100))) for i in range(50)]
    _check_near(spark.createDataFrame(made, "doc_id long, text string"), 5)


def test_near_one_id_several_texts(spark):
    """Rows that share a doc_id are one node, with all links of all their texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    made = [(1, a), (2, a + " more"), (2, b), (3, b + " again"), (4, c), (4, c), (5, c + " x"), (6, "alone here"), (6, None)]
    _check_near(spark.createDataFrame(made, "doc_id long, text string"), 2)


def test_near_sf001(spark):
    _check_near(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 5)


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    other = base.copy()
    other[:111] = rng.integers(0, 1 << 63, 111).astype(np.uint64)  # similarity 0.8
    rows_ = near_dedup.samples([np.unique(base), np.unique(other)], near_dedup.BANDS * near_dedup.ROWS)
    assert abs((rows_[0] == rows_[1]).mean() - 0.8) < 0.1
    a, b = near_dedup.odd_sketch(rows_)
    differing = int(np.bitwise_count(a ^ b).sum())
    assert differing <= near_dedup.most_differing()


def test_graph(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (200, 200)]
    for local in (1 << 20, 4):
        monkeypatch.setattr(graph, "LOCAL_EDGES", local)
        with common.Scratch(spark) as scratch:
            got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7), scratch).collect()))
            assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
            assert graph.components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_scratch_leaves_nothing(spark):
    system, path = common.open_fs(common.shared_root(spark))
    from pyarrow import fs

    before = {f.path for f in system.get_file_info(fs.FileSelector(path))}
    near_dedup.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string"), 2).collect()
    after = {f.path.rsplit("/", 1)[1] for f in system.get_file_info(fs.FileSelector(path))} - {p.rsplit("/", 1)[1] for p in before}
    assert len(after) == 1 and after.pop().startswith("near-")


def test_exact_odd(spark, odd, empty):
    got = exact_dedup.groups(odd).collect()
    by_text = defaultdict(list)
    for r in rows():
        by_text[r[1] or ""].append(r[0])
    want = []
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert exact_dedup.groups(empty).count() == 0
    with common.Scratch(spark) as scratch:
        for docs in (odd, odd.withColumns({c: F.lit(None).cast("int") for c in ("length", "head", "whole", "keep_id", "copies", "survives")})):
            kept = exact_dedup.keepers(docs, scratch)
            assert kept.columns == docs.columns
            assert sorted((r["text"] or "") for r in kept.collect()) == sorted(by_text)
            assert exact_dedup.keepers(docs.limit(0), scratch).columns == docs.columns


def test_exact_beyond_broadcast(odd, monkeypatch):
    want = sorted(map(tuple, exact_dedup.groups(odd).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, exact_dedup.groups(odd).collect()), key=str) == want


def test_exact_refines(spark):
    """Only rows whose length and prefix are shared reach the whole hash."""
    head = "p" * 64
    made = [(1, "a"), (2, "bb"), (3, "cc"), (4, head + "x"), (5, head + "y"), (6, head + "y"), (7, head + "longer")]
    with common.Scratch(spark) as scratch:
        rows, names, found = exact_dedup.refined(spark.createDataFrame(made, "doc_id long, text string"), 64, scratch)
        assert {r["doc_id"] for r in rows.where(F.col(names[2]).isNotNull()).collect()} == {4, 5, 6}
        assert [(r["keep_id"], r["group_size"], r["copies"]) for r in found.collect()] == [(6, 2, 1)]


@pytest.mark.parametrize("hot", [1e-3, 0.3])
def test_exact_refines_at_every_size(spark, monkeypatch, hot):
    """Beyond the broadcast bound the same rows are hashed, and the same stay; with pairs that are hot and pairs that aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("slot", F.lit(1))
    more = docs.limit(1).crossJoin(spark.range(400).select((F.col("id") + 10**6).alias("i"))).withColumn("doc_id", F.col("i")).drop("i")
    docs = docs.unionByName(more)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot)
    found = []
    for size in (common.BROADCAST_BYTES, 0, 64 * 50):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        with common.Scratch(spark) as scratch:
            rows, names, groups = exact_dedup.refined(docs, 64, scratch)
            hashed = sorted(r[0] for r in rows.where(F.col(names[2]).isNotNull()).select("doc_id").collect())
            found.append((hashed, rows.count(), sorted(map(tuple, groups.select("keep_id", "copies", "group_size").collect())), sorted(r[0] for r in exact_dedup.keepers(docs, scratch).select("doc_id").collect())))
    assert found[0] == found[1] == found[2] and 400 < len(found[0][0]) < 600


def test_exact_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = exact_dedup.op10_exact_dedup(spark, data)
    assert sorted(map(tuple, got.select("doc_id", "group_size", "keep_id", "kept", "text_sha256").collect())) == sorted(con.execute(f"SELECT doc_id, group_size, keep_id, kept, text_sha256 FROM ({exact_dedup.OP10_SQL})").fetchall())


def test_fingerprints(spark, data, documents, monkeypatch):
    got = {r["doc_id"]: r for r in imatch.op9_imatch(spark, data).collect()}
    texts = [(r[0], r[1]) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    assert len(got) == len(texts)
    prints = defaultdict(set)
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(got[i]["fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.2 and mean("near_next") < 0.1


def test_fingerprints_odd(odd, empty):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == len(rows())
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["fingerprint"])
    assert by_id[5] == by_id[6] and by_id[0] == by_id[1] == by_id[19] == {"-"} and by_id[5] != by_id[12]
    assert imatch.fingerprints(empty).count() == 0


def _print(text, band):
    """The fingerprint by plain Python."""
    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda parts: signed(_chained(xxhash.xxh64_intdigest, parts))
    words = {chain([w.encode()]) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    used = words & band if len(words & band) >= imatch.LEAST else words
    if not words:
        return "-", None
    out = []
    for i in range(imatch.SUBSETS):
        draws = [(chain([h.to_bytes(8, "little", signed=True), i.to_bytes(4, "little")]), h) for h in sorted(used)]
        rows = [[h for d, h in draws if d & ((1 << r) - 1) == 0] for r in imatch.RATES]
        out.append([chain([h.to_bytes(8, "little", signed=True) for h in row]) & 0xFFFFFFFF if row else None for row in rows])
    return ":".join(",".join("" if h is None else f"{h:x}" for h in row) for row in out), out


def _chained(digest, parts):
    seed = 42
    for p in parts:
        seed = digest(p, seed=seed)
    return seed


def _like(a, b):
    if a is None or b is None:
        return float(a is b)
    best = None
    for k in range(len(imatch.RATES)):
        met = [x[k] == y[k] for x, y in zip(a, b, strict=True) if x[k] is not None and y[k] is not None]
        if len(met) >= imatch.SUBSETS // 2:
            best = max(best or 0, sum(met) / len(met))
    return float(a == b) if best is None else best


def test_fingerprints_brute_force(spark, data, documents):
    """Lexicon, fingerprints and likenesses of the query equal plain ones, on given texts and on all odd ones."""
    import regex
    import xxhash

    odd_texts = [None, "", "  ", "one", "One ONE one", "İstanbul ΣΑΣ é x", "日本語 テキスト", "a b c d e f g", "!!!", "one two three four five six"]
    far = documents.agg(F.max("doc_id")).first()[0]
    extra = spark.createDataFrame([(far + 1 + i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(extra).withColumns({"_key": F.lit(1), "used": F.lit("x"), "print": F.lit(2)})
    texts = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    count = Counter(h for _, t in texts for h in {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w})
    band = {h for h, n in count.items() if max(2, imatch.LOW * len(texts)) <= n <= imatch.HIGH * len(texts)}
    got = {r["doc_id"]: r for r in imatch.with_edits(docs).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, own_parts = _print(t, band)
        new, new_parts = _print(edited, band)
        _, next_parts = _print(after, band)
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (own, new, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - _like(own_parts, new_parts)) < 1e-9 and abs(r["near_next"] - _like(own_parts, next_parts)) < 1e-9


def test_fingerprints_odd_query(spark, odd, empty):
    """The whole query on nulls, null and repeated doc_ids, clashing names, one document, and none."""
    got = imatch.with_edits(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(text or "") for r in got for text in [next(t for i, t, *_ in rows() if i == r["doc_id"])] if r["doc_id"] is not None)
    one = imatch.with_edits(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest() and one[0]["near_next"] == 1.0
    assert imatch.with_edits(empty).count() == 0


def test_successors(odd, empty):
    docs = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = imatch.with_next(docs, ["text", "doc_id"]).collect()
    assert len(got) == len(rows())
    order = sorted((r for r in got), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
    last = [r for r in order if r["doc_id"] == 9_000_000_000]
    assert last[0]["next_doc_id"] is None and {r["next_doc_id"] for r in got if r["doc_id"] == 7} == {8}
    assert imatch.with_next(empty.select("doc_id", "text"), ["text"]).count() == 0


def test_sketch_loses_less_than_bands():
    """At similarity 0.8 the limit of differing bits lies six standard deviations above the mean."""
    import numpy as np

    rng, n = np.random.default_rng(1), near_dedup.BANDS * near_dedup.ROWS
    differing = []
    for _ in range(10):
        a = rng.integers(0, 1 << 32, (2000, n), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < 0.2, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32), a)
        differing.append(np.bitwise_count(near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).sum(axis=1, dtype=np.int64))
    differing = np.concatenate(differing)
    assert near_dedup.most_differing() >= differing.mean() + 6 * differing.std()


def test_near_one_python_step_a_stage(spark, monkeypatch):
    """What the components are asked for is a table: a second Python step in its stage would be a second worker for each task."""
    asked, found = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges, scratch: asked.append(edges._jdf.queryExecution().optimizedPlan().toString()) or found(edges, scratch))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i % 3}") for i in range(9)], "doc_id long, text string")
    near_dedup.near_duplicates(docs, 2)
    assert len(asked) >= 2 and not any("MapInArrow" in plan for plan in asked)
