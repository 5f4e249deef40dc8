"""Operators 2, 3 and 7 against the libraries."""

import hashlib
import heapq
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inventra.llm import common, packing, sentencepieces, token_files, tokens

from .conftest import rows

WORD, PIECE = tokens.default_path("word_bpe_49k.json"), tokens.default_path("piece_bpe_32k.model")


def _library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_chunks_equal_library(documents):
    texts = [r[1] or "" for r in rows()] + [r[0] for r in documents.select("text").collect()]
    got = tokens.chunk_tokenizer(WORD).encode(pa.array(texts))
    ends = np.concatenate([[0], got.ends])
    assert [got.flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == _library(texts)


def test_pieces_equal_library(documents):
    model = sentencepieces.piece_model(PIECE)
    texts = [r[1] or "" for r in rows()] + [r[0] for r in documents.select("text").collect()] + ["ab" * 500, "aaaa" * 99, "a  b   c", "\n \n", "<s> <0x0A>"]
    want = model.library.encode(texts)
    got = model.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [t.decode() for t in model.decode(got)] == [model.library.decode(w) for w in want]


def test_round_trip_rows(odd, empty):
    model = sentencepieces.piece_model(PIECE)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepieces.round_trip(odd, PIECE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows():
        ids = model.library.encode(r[1] or "")
        want.append((-1 if r[0] is None else r[0], len(ids), sha(",".join(map(str, ids))), sha(model.library.decode(ids))))
    assert got == sorted(want)
    assert sentencepieces.round_trip(empty, PIECE).count() == 0
    back = {r[0]: r[1] for r in sentencepieces.decode(sentencepieces.encode(odd, PIECE), PIECE).collect() if r[0] is not None}
    assert back[5] == rows()[5][1] and back[0] == ""


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(odd, empty, capacity):
    ids = defaultdict(list)
    for r in rows():
        ids[r[0]].append(_library([r[1] or ""])[0] + [packing.END_ID])
    got = packing.pack(odd, WORD, capacity).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append(r)
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
    for rows_ in windows.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    assert packing.pack(empty, WORD).count() == 0


def test_packing_documents(documents):
    """Each document's pieces tile it exactly once, with the library's ids; windows are gapless and nearly full."""
    got = packing.pack(documents, WORD).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    texts = documents.select("doc_id", "text").collect()
    assert len(pieces) == len(texts)
    for (doc_id, _), ids in zip(texts, _library([t for _, t in texts]), strict=True):
        ids, at = np.array([*ids, packing.END_ID], "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows_ in windows.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in got) >= 0.95 * packing.CAPACITY * len(windows)


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 4096, 700)
    groups = packing.deal(sizes, 4096)
    assert sorted(i for g in groups for i in g) == list(range(700))
    sums = np.array([sizes[g].sum() for g in groups])
    assert sums.max() <= 4096 and len(groups) <= 1.03 * sizes.sum() / 4096
    assert packing.deal(np.array([4000, 4000, 4000]), 4096) == [[0], [1], [2]] or len(packing.deal(np.array([4000, 4000, 4000]), 4096)) == 3
    assert np.ptp([sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.difference(np.array([8, 7, 6, 5, 4]), 2)]) == 2
    assert packing.deal(np.zeros(0, np.int64), 10) == []


def test_token_files(spark, odd, empty):
    folder = common.shared_folder(spark, "token-test")
    manifest = token_files.write(odd, folder, WORD).orderBy("shard").collect()
    got = token_files.read(spark, folder).collect()
    want = sorted(rows(), key=lambda r: -(1 << 62) if r[0] is None else r[0])
    ids = {(r[0], r[1]): _library([r[1] or ""])[0] + [token_files.END_ID] for r in want}
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    key = lambda d, n, c: (-1 if d is None else d, n, c)
    assert sorted(key(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(key(r[0], len(x := ids[r[0], r[1]]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in want)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None, None] + sorted(i for i in order if i is not None)
    assert sum(m["n_docs"] for m in manifest) == len(want) and manifest[0]["first"] == 0 and manifest[0]["tokenizer"] == "word_bpe_49k.json" and len(manifest[0]["tokenizer_sha256"]) == 64
    assert all(b["first"] == a["first"] + a["n_ids"] for a, b in zip(manifest, manifest[1:], strict=False))
    shard = token_files.Shard(folder, manifest[0]["shard"])
    assert shard.ids(len(shard) - 1).tolist() == list(shard)[-1].tolist()
    none = common.shared_folder(spark, "token-none")
    assert token_files.write(empty, none, WORD).count() == 0 and token_files.read(spark, none).count() == 0


def test_token_files_shards(spark, documents, data, monkeypatch):
    """Many shards, equal doc_ids dealt over several, long texts only: the ids read back are the same."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    docs = spark.createDataFrame([(7, f"word{i} " * 3000) for i in range(30)], "doc_id long, text string")
    folder = common.shared_folder(spark, "token-shards")
    manifest = token_files.write(docs, folder, WORD).collect()
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert len(manifest) > 5 and all(m["dictionary"] for m in manifest)
    want = sorted((len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x in _library([r[1] for r in docs.collect()]))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))


def test_long_texts_without_spaces(spark):
    """Texts of megabytes without a space: as the library, and no worker keeps them."""
    model = sentencepieces.piece_model(PIECE)
    texts = ["ab0" * 200_000, "日本語" * 40_000, "q" * 100_000]
    assert [r.tolist() for r in model.encode(texts)] == model.library.encode(texts)
    assert all(len(u) <= sentencepieces.MEMO_LONGEST for u in model.memo)
    coder = tokens.chunk_tokenizer(WORD)
    import pyarrow as pa

    got, start = coder.encode(pa.array(texts)), 0
    for want, end in zip(_library(texts), got.ends.tolist(), strict=True):
        assert got.flat[start:end].tolist() == want
        start = end
    assert all(len(w) <= tokens.MEMO_LONGEST for table in (coder.pieces, coder.others) for w in table)


def test_whole_table(spark, documents, data):
    got = {r["doc_id"]: r for r in token_files.op7_token_files(spark, data).collect()}
    texts = documents.orderBy("doc_id").select("doc_id", "text").collect()
    start = 0
    for (doc_id, _), ids in zip(texts, _library([t for _, t in texts]), strict=True):
        ids = [*ids, 2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def _plain_difference(sizes, windows):
    """Karmarkar-Karp with lists of indices."""
    heap = [(-int(s) if windows > 1 else 0, i) for i, s in enumerate(sizes)]
    parts = {i: [(int(s), [i])] for i, s in enumerate(sizes)}
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        x, y = (y, x) if len(x) < len(y) else (x, y)
        empty = max(0, windows - len(x))
        merged = x + y[:empty]
        for k, (size, group) in enumerate(y[empty:]):
            total, own = merged[len(x) - 1 - k]
            merged[len(x) - 1 - k] = total + size, own + group
        merged.sort(key=lambda w: -w[0])
        fresh = len(sizes) + len(sizes) - len(heap) - 1
        parts[fresh] = merged
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0] if len(merged) == windows else merged[0][0]), fresh))
    return [g for _, g in parts.popitem()[1]] if parts else []


@pytest.mark.parametrize("windows", [1, 2, 7, 30, 400])
def test_difference_equals_plain(windows):
    made = np.random.default_rng(windows)
    for n in (0, 1, 2, 3, 40, 300):
        sizes = made.integers(1, 4096, n)
        assert packing.difference(sizes, windows) == _plain_difference(sizes, windows)


def test_difference_time():
    """A block whose windows hold two rests each takes well under the time that lists of indices take."""
    sizes = np.random.default_rng(1).integers(1, 4095, 2048)
    took = []
    for f in (packing.difference, _plain_difference) * 3:
        began = time.process_time()
        f(sizes, 1050)
        took.append(time.process_time() - began)
    assert min(took[::2]) < 0.75 * min(took[1::2])
