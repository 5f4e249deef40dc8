"""Operator 6: quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is over bytes, of order ORDER, one for each language, trained on all trusted documents (those
labelled good and not toxic), with no bound on their number. Windows are counted in part within each
task and added up by key; lower orders count distinct continuations; discounts follow from the counts of counts of
each language and order. Probabilities come from joins of count tables on contexts and on shorter
windows, dealt by key.

Scoring is a join of the documents' distinct windows with the model, both dealt into shards by model and by the window's third and
fourth byte, so that a window, its contexts and its shorter forms of three bytes and more lie in one shard (the tables of one
and two bytes are at most 66,000 rows a model and are read with it). A task takes its partition in slices of SLICE windows and asks once for each distinct window of a
slice; requests and answers travel as compressed arrays (about 4 bytes a window), a row for each slice and shard; each shard of the model is read once
for SALT_PARTITIONS partitions that ask. The answers go back as a file for each slice, and a second pass over the
documents adds up log-probabilities from the files of its slices. Texts never move. If that pass finds its rows
dealt otherwise (a source that isn't a table), windows without an answer are looked up in the model's shards.

A document's perplexity is that of its bytes. A document is rejected if it exceeds the limit of its
language and length class: QUANTILE of the trusted documents' held-out perplexities there. For these, trusted texts are dealt
by hash to FOLDS folds (equal texts to the same one), and each is scored by a model of its language without its fold, so
that the limit is what unseen documents as good stay within at any size of the input. The models without a fold are
trained together with the whole one, from the same counts less the fold's own; the discounts are those of the whole.
Classes of fewer than class_least trusted documents (a parameter, CLASS_LEAST) take their language's limit: of fewer the QUANTILE
is hardly more than the largest.
A language of fewer than language_least different trusted texts (a parameter, LANGUAGE_LEAST) has no limit: the largest of n
perplexities is exceeded by one in n + 1 documents that are as good, and a model of a few texts finds any other text unlikely.

Defined results: null text is empty; empty texts, texts whose language has too few trusted texts, and rows with a null doc_id
are kept (perplexity null for empty texts and languages with no trusted text, limit null for all of the first two); null languages are a language of their own; rows that share a
doc_id are scored each (text_hash tells them apart); an empty table gives no rows; other columns are not read. Any number of
languages may occur (a key has room for 1.3 million).
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

ORDER = 5
QUANTILE = 0.99
FOLDS = 5
#: Models of a language: of all its trusted texts, and without each fold.
MODELS = FOLDS + 1
CLASS_LEAST = 200
LANGUAGE_LEAST = 30
#: Rows of a shard of the model; partitions whose requests meet one reading of a shard.
SHARD_ROWS = 1_000_000
SALT_PARTITIONS = 64
#: Answers are rounded to so many steps of a bit: perplexities hold to 3e-6 of themselves.
STEPS = 1 << 17
#: Bytes of text whose windows are in memory together.
BLOCK = 1 << 19
#: Windows whose distinct ones are asked for together: a task's memory doesn't follow the size of its partition.
SLICE = 1 << 24
#: Rows of a batch whose rows are packed arrays.
PACKED_ROWS = 32
_NO_LANGUAGE = "und"
_SCORES = "doc_id long, text_hash long, l int, held boolean, n_bytes long, perplexity double"
_PAIR = 40503


def windows(texts: list[str], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (number of the language or model, then ORDER bytes) of the window that ends at each byte, and each text's number of bytes."""
    pad = b"\0" * (ORDER - 1)
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(pad.join([b"", *raw]), np.uint8).astype(np.int64)
    n = len(data) - ORDER + 1
    key = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER):
        key = key << 8 | data[k : k + n]
    # Between two texts lie ORDER - 1 zero bytes; the windows that end in them are of no text.
    gap = sizes.cumsum() + (ORDER - 1) * np.arange(len(sizes))
    keep = np.ones(len(key), bool)
    for k in range(ORDER - 1):
        at = gap[:-1] + k
        keep[at[at < len(keep)]] = False
    return key[keep] | np.repeat(langs.astype(np.int64), sizes) << (8 * ORDER), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lang = batch.column("text"), batch.column("l").to_numpy()
        for a, b in tokens.blocks(texts, BLOCK):
            key, n = common.counted(windows(texts.slice(a, b - a).to_pylist(), lang[a:b])[0])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _suffix(order: int) -> Column:
    """The key without its first byte."""
    low = 8 * (order - 1)
    return F.shiftleft(F.shiftright("key", 8 * order), low).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << low) - 1)))


def _discounts(counts: DataFrame, order: int) -> DataFrame:
    """l, d1, d2, d3: Chen and Goodman's three discounts of each language, from its whole model; a row a language."""
    model = F.shiftright("key", 8 * order)
    rows = counts.where((F.col("n") <= 4) & (model % MODELS == 0)).groupBy((model / MODELS).cast("long").alias("l"))
    c = {k: F.col(f"c{k}") for k in range(1, 5)}
    y = c[1] / (c[1] + 2 * c[2])
    made = [F.when(c[k] > 0, k - (k + 1) * y * c[k + 1] / c[k]).otherwise(0.5 * k) for k in (1, 2, 3)]
    known = (c[1] > 0) & (c[2] > 0)
    held = [F.when(known, F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit((0.5, 0.75, 0.9)[k - 1])).alias(f"d{k}") for k, d in enumerate(made, 1)]
    return rows.agg(*[F.count_if(F.col("n") == k).alias(f"c{k}") for k in range(1, 5)]).select("l", *held)


def _tables(counts: DataFrame, order: int, lower: DataFrame | None, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Probabilities of an order's windows (key, p) and the weight of the lower order after each context (key, g)."""
    known = common.bounded(scratch.written(_discounts(counts, order), "discounts"))
    held = F.when(F.col("n") == 1, F.coalesce("d1", F.lit(0.5))).when(F.col("n") == 2, F.coalesce("d2", F.lit(0.75))).otherwise(F.coalesce("d3", F.lit(0.9)))
    rows = counts.withColumn("l", F.floor(F.shiftright("key", 8 * order) / MODELS)).join(known, "l", "left")
    rows = rows.select("key", "n", held.alias("d"), F.shiftright("key", 8).alias("context"), _suffix(order).alias("shorter"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("held")).select("context", "total", (F.col("held") / F.col("total")).alias("g"))
    joined = rows.join(contexts, "context")
    if lower is None:
        base = F.lit(1 / 256)
    else:
        joined, base = joined.join(lower.select(F.col("key").alias("shorter"), F.col("p").alias("base")), "shorter"), F.col("base")
    return joined.select("key", ((F.col("n") - F.col("d")) / F.col("total") + F.col("g") * base).alias("p")), contexts.select(F.col("context").alias("key"), "g")


def fold() -> Column:
    return common.pick(F.xxhash64("text"), FOLDS)


def _windows(trusted: DataFrame) -> DataFrame:
    """Counts (key, n) of the windows of every model: model MODELS * l is of all texts, the k-th after it of all but fold k - 1."""
    low = 8 * ORDER
    dealt = trusted.select("text", (F.col("l") * FOLDS + fold()).cast("int").alias("l"))
    found = common.in_batches(dealt, _count, "key long, n long").withColumn("dealt", F.shiftright("key", low))
    window = F.shiftleft(F.floor(F.col("dealt") / FOLDS), low).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << low) - 1)))
    own = [F.sum(F.when(F.col("dealt") % FOLDS == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
    each = found.groupBy(window.alias("window")).agg(F.sum("n").alias("all"), *own)
    models = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), n.alias("n")) for k, n in enumerate([F.col("all"), *[F.col("all") - F.col(f"n{k}") for k in range(FOLDS)]])])
    rows = each.select("window", F.explode(models).alias("m")).where("m.n > 0")
    number = F.shiftright("window", low) * MODELS + F.col("m.k")
    return rows.select(F.shiftleft(number, low).bitwiseOR(F.col("window").bitwiseAND(F.lit((1 << low) - 1))).alias("key"), F.col("m.n").alias("n"))


class Layout:
    """Where the model lies: folder, and for each model its first shard and its number of shards."""

    def __init__(self, folder: str, windows: dict[int, int]) -> None:
        self.folder = folder
        n = max(windows, default=-1) + 1
        self.count = np.array([-(-3 * windows.get(m, 0) // SHARD_ROWS) for m in range(n)], np.int64)
        self.first = self.count.cumsum() - self.count

    def shard(self, keys: np.ndarray) -> np.ndarray:
        """Of each window; -1 where its model was never trained."""
        model, pair = keys >> (8 * ORDER), (keys >> 8) & 0xFFFF
        known = model < len(self.count)
        out = np.full(len(keys), -1, np.int64)
        count = np.zeros(len(keys), np.int64)
        count[known] = self.count[model[known]]
        at = np.flatnonzero(count)
        out[at] = self.first[model[at]] + ((pair[at] * _PAIR) & 0xFFFF) % count[at]
        return out


def train(trusted: DataFrame, scratch: common.Scratch) -> Layout:
    """Trains on rows (text, l: number of the language); the tables lie in the scratch's shared folder."""
    spark = trusted.sparkSession
    counts = {ORDER: scratch.written(_windows(trusted), "windows")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = scratch.written(counts[order + 1].select(_suffix(order + 1).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "windows")
    layout = Layout(scratch.folder("model"), {int(r[0]): r[1] for r in counts[ORDER].groupBy(F.shiftright("key", 8 * ORDER)).count().collect()})
    places = common.few(spark, [(m, int(f), int(c)) for m, (f, c) in enumerate(zip(layout.first, layout.count, strict=True))], "model long, first long, shards long")
    lower, parts, low = None, [], []
    for order in range(1, ORDER + 1):
        p, g = _tables(counts[order], order, lower, scratch)
        lower = scratch.written(p, "p")
        for rows, table, bytes_, pair in ((lower, f"p{order}", order, F.shiftright("key", 8)), (g, f"g{order}", order - 1, F.col("key"))):
            rows = rows.select(F.lit(10 * order + (table[0] == "g")).alias("t"), "key", F.col(table[0]).alias("value"), F.shiftright("key", 8 * bytes_).alias("model"), pair.bitwiseAND(F.lit(0xFFFF)).alias("pair"))
            (parts if order > 2 else low).append(rows)
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    n = common.partitions(spark)
    dealt = union(parts).join(common.bounded(places), "model").select(((F.col("pair") * _PAIR).bitwiseAND(F.lit(0xFFFF)) % F.col("shards") + F.col("first")).alias("shard"), "t", "key", "value")
    dealt.repartition(n, "shard").write.partitionBy("shard").parquet(f"{layout.folder}/shards")
    union(low).drop("pair").repartition(n, "model").write.partitionBy("model").parquet(f"{layout.folder}/low")
    scratch.dropped(*counts.values())
    return layout


def _read(path: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values of each table below a folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, where = common.open_fs(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(where, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                found.append(pq.ParquetFile(f).read(columns=["t", "key", "value"]))
    if not found:
        return {}
    rows = pa.concat_tables(found).combine_chunks()
    kind, key, value = (rows.column(c).to_numpy() for c in ("t", "key", "value"))
    out = {}
    for t in np.unique(kind).tolist():
        at = np.flatnonzero(kind == t)
        at = at[np.argsort(key[at])]
        out[f"{'pg'[t % 10]}{t // 10}"] = key[at], value[at]
    return out


@functools.lru_cache(maxsize=1)
def _shard(folder: str, shard: int) -> dict:
    return _read(f"{folder}/shards/shard={shard}")


@functools.lru_cache(maxsize=4)
def _low(folder: str, model: int) -> dict:
    return _read(f"{folder}/low/model={model}")


def _look(tables: dict, table: str, keys: np.ndarray) -> np.ndarray:
    """Values of the keys, nan where there are none."""
    out = np.full(len(keys), np.nan)
    known, values = tables.get(table, (np.zeros(0, np.int64), np.zeros(0)))
    if len(known):
        where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[where] == keys
        out[hit] = values[where[hit]]
    return out


def _within(tables: dict, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Probabilities of distinct windows of one shard; what was never seen falls to the shorter one, weighted by its context."""
    if not order:
        return np.full(len(keys), 1 / 256)
    out = _look(tables, f"p{order}", keys)
    missing = np.flatnonzero(np.isnan(out))
    if len(missing):
        rest = keys[missing]
        weight = _look(tables, f"g{order}", rest >> 8)
        low = 8 * (order - 1)
        short, back = np.unique(rest >> (8 * order) << low | rest & ((1 << low) - 1), return_inverse=True)
        out[missing] = np.where(np.isnan(weight), 1.0, weight) * _within(tables, short, order - 1)[back]
    return out


def probability(layout: Layout, keys: np.ndarray) -> np.ndarray:
    """Of distinct windows, read from the model's shards; nan where the model was never trained."""
    out, of = np.full(len(keys), np.nan), layout.shard(keys)
    for shard in np.unique(of[of >= 0]).tolist():
        at = np.flatnonzero(of == shard)
        model = int(keys[at[0]] >> (8 * ORDER))
        out[at] = _within(_shard(layout.folder, shard) | _low(layout.folder, model), keys[at])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows (text, m: number of the model), their windows, and the texts' sizes."""
    for batch in batches:
        texts, number = batch.column("text"), batch.column("m").to_numpy()
        for a, b in tokens.blocks(texts, BLOCK):
            yield batch.slice(a, b - a), *windows(texts.slice(a, b - a).to_pylist(), number[a:b])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _turned(keys: np.ndarray) -> np.ndarray:
    """Windows with the third and fourth byte before the others, so that those of a shard lie close together; _back is the inverse."""
    return keys >> 40 << 40 | (keys >> 8 & 0xFFFF) << 24 | keys >> 24 << 8 & 0xFFFF00 | keys & 0xFF


def _back(turned: np.ndarray) -> np.ndarray:
    return turned >> 40 << 40 | (turned >> 8 & 0xFFFF) << 24 | (turned >> 24 & 0xFFFF) << 8 | turned & 0xFF


def _pieces(parts: list[tuple[int, bytes]]) -> bytes:
    """Packed arrays of several shards in one file."""
    return b"".join(struct.pack("<QQ", shard, len(raw)) + raw for shard, raw in parts)


def _pieces_of(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while at < len(raw):
        shard, n = struct.unpack_from("<QQ", raw, at)
        yield shard, _unpacked(raw[at + 16 : at + 16 + n])
        at += 16 + n


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A partition's blocks (rows, windows, sizes), each with the number of its slice, which no other slice of the table has."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for rows, keys, sizes in _blocks(batches):
        yield number, rows, keys, sizes
        size += len(keys)
        if size >= SLICE:
            number, size = number + 1, 0


def _distinct(blocks: Iterator[tuple]) -> np.ndarray:
    """The distinct windows of blocks, turned; only distinct ones are held."""
    every, fresh, n = np.zeros(0, np.int64), [], 0
    for _, _, keys, _ in blocks:
        fresh.append(common.distinct(_turned(keys)))
        n += len(fresh[-1])
        if n > max(1 << 20, len(every)):
            every, fresh, n = common.distinct(np.concatenate([every, *fresh])), [], 0
    return common.distinct(np.concatenate([every, *fresh]))


def _ask(batches: Iterator[pa.RecordBatch], layout: Layout, folder: str) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each slice, a row a shard; they are kept in a file as well."""
    for chunk, blocks in itertools.groupby(_numbered(batches), key=lambda x: x[0]):
        every = _distinct(blocks)
        of = layout.shard(_back(every))
        order = np.argsort(of, kind="stable")
        every, of = every[order], of[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
        parts = [(int(of[a]), _packed(np.diff(every[a:b], prepend=0))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if of[a] >= 0]
        del every, of, order
        if parts:
            common.write_file(f"{folder}/{chunk}.ask", _pieces(parts))
        for shard, raw in parts:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([shard], pa.int64()), pa.array([raw], pa.binary())], ["chunk", "shard", "keys"])


def _answer(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Bits of each row's windows, in STEPS of a bit; rows come sorted by shard."""
    for batch in batches:
        for i, raw in enumerate(batch.column("keys")):
            bits = -np.log2(probability(layout, _back(_unpacked(raw.as_py()).cumsum())))
            yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), batch.column("shard").slice(i, 1), pa.array([_packed(np.rint(bits * STEPS))], pa.binary())], ["chunk", "shard", "bits"])
    _shard.cache_clear()  # the worker stays for later tasks
    _low.cache_clear()


def _deliver(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes each slice's answers as one file; rows come sorted by chunk."""
    chunk, parts = None, []

    def put() -> pa.RecordBatch:
        common.write_file(f"{folder}/{chunk}.bits", _pieces(parts))
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "n": [len(parts)]})

    for batch in batches:
        for c, shard, raw in zip(batch.column("chunk").to_pylist(), batch.column("shard").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            if c != chunk and parts:
                yield put()
                parts = []
            chunk = c
            parts.append((shard, raw))
    if parts:
        yield put()


def _delivered(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """A slice's windows in order, and their bits."""
    try:
        asked, told = (common.read_file(f"{folder}/{chunk}.{kind}") for kind in ("ask", "bits"))
    except FileNotFoundError:
        return np.zeros(0, np.int64), np.zeros(0)
    bits = dict(_pieces_of(told))
    keys = {shard: _back(turned.cumsum()) for shard, turned in _pieces_of(asked) if shard in bits}
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(list(keys.values()))
    order = np.argsort(key)
    return key[order], np.concatenate([bits[s] for s in keys])[order] / STEPS


def _score(batches: Iterator[pa.RecordBatch], layout: Layout, folder: str) -> Iterator[pa.RecordBatch]:
    """Perplexities of rows (doc_id, text_hash, l, held, text, m), by their slice's answers; what a slice hasn't asked for (its rows came in another order) is read from the model."""
    current, known, bits = None, np.zeros(0, np.int64), np.zeros(0)
    for chunk, rows, keys, sizes in _numbered(batches):
        if chunk != current:
            known = bits = None
            current, (known, bits) = chunk, _delivered(folder, chunk)
        distinct = common.distinct(keys)
        value = np.full(len(distinct), np.nan)
        if len(known):
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            hit = known[at] == distinct
            value[hit] = bits[at[hit]]
        if len(missing := np.flatnonzero(np.isnan(value) & (layout.shard(distinct) >= 0))):
            value[missing] = np.rint(-np.log2(probability(layout, distinct[missing])) * STEPS) / STEPS
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=value[np.searchsorted(distinct, keys)], minlength=len(sizes))
        perplexity = np.exp2(total / np.maximum(sizes, 1))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "text_hash", "l", "held")), pa.array(sizes), pa.array(perplexity, mask=np.isnan(perplexity) | (sizes == 0))], ["doc_id", "text_hash", "l", "held", "n_bytes", "perplexity"])
    _shard.cache_clear()
    _low.cache_clear()


def perplexities(rows: DataFrame, layout: Layout, scratch: common.Scratch) -> DataFrame:
    """doc_id, text_hash, l, held, n_bytes, perplexity of rows (doc_id, text_hash, l, held, text, m: number of the model); a table of the scratch."""
    n, folder = common.partitions(rows.sparkSession), scratch.folder("answers")
    with common.batch_rows(rows.sparkSession, PACKED_ROWS):
        _exchange(rows, layout, folder, n, scratch)
    return scratch.written(common.in_batches(rows, functools.partial(_score, layout=layout, folder=folder), _SCORES), "scores")


def _exchange(rows: DataFrame, layout: Layout, folder: str, n: int, scratch: common.Scratch) -> None:
    """Requests to the shards, and answers to the slices' files."""
    asked = common.in_batches(rows, functools.partial(_ask, layout=layout, folder=folder), "chunk long, shard long, keys binary")
    asked = asked.repartition(n, "shard", F.floor(F.shiftright("chunk", 32) / SALT_PARTITIONS)).sortWithinPartitions("shard")
    answered = common.in_batches(asked, functools.partial(_answer, layout=layout), "chunk long, shard long, bits binary")
    answered = answered.repartition(n, "chunk").sortWithinPartitions("chunk")
    scratch.written(common.in_batches(answered, functools.partial(_deliver, folder=folder), "chunk long, n long"), "delivered")


def length_class(n_bytes: Column) -> Column:
    """Classes of length by factors of four, from 0 for less than 64 bytes to 5."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(n_bytes, F.lit(1)).cast("double")) / 2) - 2, F.lit(0)), F.lit(5)).cast("int")


def scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, class_least: int = CLASS_LEAST, language_least: int = LANGUAGE_LEAST) -> DataFrame:
    """doc_id, text_hash, lang, n_bytes, perplexity, perplexity_limit, kept of every row."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANGUAGE)).alias("lang")
    with common.Scratch(spark) as scratch:
        names = [r[0] for r in docs.select(lang).distinct().orderBy("lang").collect()]  # a name and a number a language
        numbers = common.few(spark, list(enumerate(names)), "l int, lang string")
        good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).distinct()
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang)
        rows = rows.join(common.bounded(numbers), "lang").join(common.bounded(good), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
        trusted = rows.where("good and text <> ''")
        learnt = dict(trusted.groupBy("l").agg(F.countDistinct(F.xxhash64("text"))).collect())
        layout = train(trusted, scratch)
        enough = common.few(spark, [(i, n >= language_least) for i, n in learnt.items()], "l int, enough boolean")
        held_model = F.struct((F.col("l") * MODELS + 1 + fold()).cast("int").alias("m"), F.lit(True).alias("held"))
        asked = F.array_compact(F.array(F.struct((F.col("l") * MODELS).cast("int").alias("m"), F.lit(False).alias("held")), F.when(F.col("good") & (F.col("text") != "") & F.coalesce("enough", F.lit(False)), held_model)))
        rows = rows.join(common.bounded(enough), "l", "left").select("doc_id", F.xxhash64("text").alias("text_hash"), "l", "text", F.explode(asked).alias("a"))
        scored = perplexities(rows.select("doc_id", "text_hash", "l", "a.held", "text", "a.m"), layout, scratch).withColumn("class", length_class(F.col("n_bytes")))
        held = scored.where("held and perplexity is not null")
        high = F.percentile_approx("perplexity", quantile, 10_000)
        wide = dict(held.groupBy("l").agg(high).collect())
        limit = {(r["l"], r["class"]): r["q"] for r in held.groupBy("l", "class").agg(high.alias("q"), F.count(F.lit(1)).alias("n")).collect() if r["n"] >= class_least}
        table = [(i, k, limit.get((i, k), wide[i])) for i in wide for k in range(6)]
        limits = common.few(spark, table, "l int, class int, perplexity_limit double")
        found = scored.where("not held").join(common.bounded(limits), ["l", "class"], "left").join(common.bounded(numbers), "l")
        found = found.withColumn("kept", F.coalesce(F.col("doc_id").isNull() | (F.col("perplexity") <= F.col("perplexity_limit")), F.lit(True)))
        return common.written(found.select("doc_id", "text_hash", "lang", "n_bytes", "perplexity", "perplexity_limit", "kept"), "quality")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
