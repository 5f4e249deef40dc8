"""Operators 11 to 13: importance resampling, fill-in-the-middle, byte-level BPE."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inventra.llm import bytes_bpe, fill_middle, importance, tokens

from .conftest import rows

BYTE = tokens.default_path("byte_bpe_50k.json")


def _sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def _same_as_sql(spark, data, query, sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


# Operator 11


def _resampled(docs, target, percent, least, seed, buckets, most):
    """The same by plain counting; docs: (doc_id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    runs = lambda w: Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1))
    split = [words(t) for _, t in docs]
    counts = [runs(w) for w in split]
    s, t = sum(counts, Counter()), sum((runs(words(x)) for x in target), Counter())
    all_s, all_t = s.total(), t.total()
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in s}
    out = []
    for (doc_id, _), w, c in zip(docs, split, counts, strict=True):
        n = c.total()
        weight = sum(gain[k] * x for k, x in c.items()) // n if n else 0
        h = int(_sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], r[1], r[2]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def _key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_importance_odd(spark, odd, empty, monkeypatch, most, buckets):
    monkeypatch.setattr(importance, "SLICE_BLOCKS", 1)  # every block is a slice
    monkeypatch.setattr(tokens, "BLOCK_ROWS", 3)
    target = spark.createDataFrame([("The committee granted the letter", 1), (None, 2), ("river STONE river é", 3), ("", 4)], "text string, doc_id int")
    for table, mine in ((odd, rows()), (empty, [])):
        got = importance.resample(table, target, 40, 5, 3, buckets, most).select("doc_id", "n_features", "weight", "score", "rank").collect()
        want = _resampled([(r[0], r[1]) for r in mine], [r[0] for r in target.collect()], 40, 5, 3, buckets, most)
        assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key)
    got = importance.resample(odd, target.limit(0)).collect()
    assert len(got) == len(rows()) and all(r["weight"] is not None for r in got)


def test_importance_sql(spark, data):
    _same_as_sql(spark, data, importance.op11_importance, importance.OP11_SQL)


def test_importance_draws_the_target(spark):
    """Documents that talk like the target are drawn first; a word that every document has, in a third of all rows one text, changes no result."""
    texts = ["common river stone water market letter winter " * 4, "common theory music school garden family number " * 4]
    docs = [(i, texts[i % 3 == 0] + f"w{i}") for i in range(300)] + [(1000 + i, texts[0]) for i in range(150)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    target = ["theory music school garden family " * 9]
    got = importance.resample(table, spark.createDataFrame([(x,) for x in target], "text string")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=_key) == sorted(_resampled(docs, target, 10, 20, 2024, 10_000, 1), key=_key)
    drawn = [r["doc_id"] for r in got if r["rank"]]
    assert len(drawn) == 45 and sum(i < 300 and i % 3 == 0 for i in drawn) > 30


# Operator 12


def test_fill_middle_odd(odd, empty):
    marked = [(50, "has <M> in it"), (51, "<"), (52, "<P"), (53, "S><M"), (54, "é😀́" * 500)]
    table = odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame(marked, "doc_id long, text string"))
    want = []
    for doc_id, text in [(r[0], r[1] or "") for r in rows()] + marked:
        h = [int(_sha(f"1:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        want.append((doc_id, len(text), form, *((None, None) if form == "plain" else (a, b - a)), _sha(output), _sha(text)))
    assert sorted(map(tuple, fill_middle.digests(table).collect()), key=_key) == sorted(want, key=_key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fill_middle.restore(fill_middle.transform(table)).collect()
    assert sorted((tuple(r) for r in back), key=_key) == sorted([(r[0], r[1] or "") for r in rows()] + marked, key=_key)
    assert fill_middle.digests(empty).count() == 0 and fill_middle.transform(empty).count() == 0


def test_fill_middle_sql(spark, data):
    _same_as_sql(spark, data, fill_middle.op12_fill_middle, fill_middle.OP12_SQL)


@pytest.mark.parametrize("unit", [r"(?s:.)", r"\S+", r"\n|[^\n]+", "zz"])
def test_places(unit):
    """Against a list of all matches."""
    rng, pattern = random.Random(5), re.compile(unit)
    for _ in range(300):
        text = "".join(rng.choice("ab \nzé😀") for _ in range(rng.randint(0, 40)))
        ends = [0, *[m.end() for m in pattern.finditer(text)]]
        assert fill_middle.count(pattern, text) == len(ends) - 1
        a, b = sorted(rng.randint(0, len(ends) - 1) for _ in range(2))
        assert fill_middle.places(pattern, text, a, b) == (ends[a], ends[b])


def test_places_memory():
    """No unit is kept: the second pass over two million units needs a few kilobytes."""
    import tracemalloc

    text, pattern = "ab" * 1_000_000, re.compile(fill_middle.UNIT)
    tracemalloc.start()
    assert fill_middle.count(pattern, text) == len(text)
    assert fill_middle.places(pattern, text, 5, len(text) - 1) == (5, len(text) - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_restored(form):
    rng = random.Random(3)
    for _ in range(500):
        parts = ["".join(rng.choice("<PSM>a") for _ in range(rng.randint(0, 4))) for _ in range(3)]
        if form == "plain" or not any(m in "".join(parts) for m in fill_middle.MARKS):
            assert fill_middle.restored(fill_middle.joined(form, *parts), form) == "".join(parts)


# Operator 13


def _strange():
    rng, letters = random.Random(1), "ab é 　\n\t '<|>sdt12.日 😀\x1c\u0085  "
    fixed = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>'s  \n\n x", "<|endoftext|", " x 　y  z é à  ", "don't I'LL 's", "a" * 5000, "ab" * 3000, "\n\n\nx\t\ty \r\n z", "𝒳 𝒴 😀 😀", "x  y", "é ​ x", "\x1c a \x1c"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]


def test_byte_bpe_equals_library(documents):
    model = bytes_bpe.byte_bpe(BYTE)
    texts = [r[1] or "" for r in rows()] + [r[0] or "" for r in documents.select("text").collect()] + _strange()
    want = [e.ids for e in model.library.encode_batch(texts, add_special_tokens=False)]
    got = model.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(got.flat, got.ends[:-1])] == want
    assert [model.decode(np.array(w, np.int64)) for w in want] == [model.library.decode(w, skip_special_tokens=False) for w in want]
    for i in range(0, len(texts), 40):
        assert model.encode_long(texts[i], 50).tolist() == want[i]
    for i in (1, 128, 5000, 33_000):  # bytes that are no UTF-8 by themselves
        ids = list(range(i, i + 60))
        assert model.decode(np.array(ids)) == model.library.decode(ids, skip_special_tokens=False)


def test_byte_bpe_cuts():
    """A pair is cut only if no entry has it; with the cuts gone, and with a cut at every certain place, ids are the same."""
    model = bytes_bpe.byte_bpe(BYTE)
    held = {t[i : i + 2] for t in model.id_of for i in range(len(t) - 1)}
    assert int((~model.cuts).sum()) == len(held) and not any(model.cuts[p[0] * 256 + p[1]] for p in held)
    rng = random.Random(2)
    for _ in range(400):
        word = bytes(rng.choice(b"abqzxjkvw'\xc3\xa9\xe6\x97\xa5.") for _ in range(rng.randint(1, 60)))
        cut = [0, *[i for i in range(1, len(word)) if model.cuts[word[i - 1] * 256 + word[i]]], len(word)]
        assert [x for a, b in zip(cut, cut[1:]) for x in model.merged(word[a:b])] == model.merged(word)
        assert model._merged_long(model.single[np.frombuffer(word, np.uint8)].tolist()) == model.merged(word)


def test_byte_bpe_odd(odd, empty, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 1000)
    model = bytes_bpe.byte_bpe(BYTE)
    want = []
    for doc_id, text in ((r[0], r[1] or "") for r in rows()):
        ids = model.library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(model.library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bytes_bpe.round_trip(odd, BYTE).collect()), key=_key) == sorted(want, key=_key)
    back = bytes_bpe.decode(bytes_bpe.encode(odd, BYTE), BYTE).collect()
    assert sorted(map(tuple, back), key=_key) == sorted([(r[0], r[1] or "") for r in rows()], key=_key)
    assert bytes_bpe.round_trip(empty, BYTE).count() == 0


def test_byte_bpe_documents(spark, documents, data):
    model = bytes_bpe.byte_bpe(BYTE)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytes_bpe.op13_byte_bpe(spark, data).collect()}
    texts = {r[0]: r[1] or "" for r in documents.select("doc_id", "text").collect()}
    assert got == {i: (len(ids := model.library.encode(t, add_special_tokens=False).ids), _sha(np.array(ids, "<u4").tobytes()), _sha(t)) for i, t in texts.items()}
    assert documents.where(F.length("text") > tokens.BLOCK_BYTES).count() == 0
