"""Operator 11: importance resampling towards a target distribution, by bucket-partitioned inverted postings.

Features are runs of 1 to `most` consecutive words, hashed into `buckets`. A bucket's gain compares how often the target has it with how often the
documents have it; a document's weight is the mean gain of its features, and the documents with the highest weight plus noise (Gumbel, fixed by
doc_id) are drawn without replacement.

1. Documents are read once, block by block (at most 1000 rows). A block becomes a head row (its doc_ids and numbers of features) and for each of PARTS parts of the buckets
   one row of inverted postings: bucket, document's place in the block, count, sorted by bucket. Both kinds are written to the shared folder in one pass, so
   block names hold from then on even if a task runs again.
2. Totals of each bucket in both corpora are added up from the blocks' own totals; there are at most `buckets` rows.
3. Postings are shuffled by part and slice and co-grouped with the totals of that part, where gains are worked out locally and turned into contributions, summed by
   block and document before they leave. A slice is a share of the blocks of about SLICE_BLOCKS, and a document has one posting a bucket at most, so no bucket, however common, brings more than
   SLICE_BLOCKS x 1000 postings into a group, whatever the number of documents: hot buckets are split by their documents, and only the totals (a few numbers a bucket) are repeated for each slice.
4. Contributions are reduced by block together with the head: at most PARTS + 1 rows a group.
5. The draw ranks narrow rows by range (operators.ordering), no task has them all.

Defined results: null texts have no words, and so weight 0 and no draw; a null doc_id draws its noise from "<seed>:" and sorts first among ties; rows that repeat a doc_id
are documents of their own with the same noise; an empty table gives no rows; an empty target has T = 0 and every t = 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordering
from . import common, tokens

BUCKETS, MOST, PARTS = 10_000, 1, 128
#: Blocks of a slice, on average.
SLICE_BLOCKS = 64
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
_POSTINGS = "block long, part int, size int, buckets array<int>, docs array<int>, counts array<int>, seen array<int>, totals array<long>, doc_ids array<long>, features array<long>, words array<long>"
_SUMS = "block long, sums array<long>"
_WEIGHTS = "doc_id long, n_features long, n_words long, weight long"
_HEAD_PART = -1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: A-Z as a-z, and whether it belongs to a word (digits, letters, all beyond ASCII)."""
    lower, word = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


_LOWER, _WORD = _tables()


def features(texts: pa.Array, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its bucket, words of each text) of a block; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    inside = _WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    starts[edges] = inside[edges]
    first = np.flatnonzero(starts)
    text_of = np.searchsorted(bounds, first, side="right") - 1
    per_text = np.bincount(text_of, minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
    compact = data[inside]
    ends = np.append(inside.cumsum()[first] - 1, len(compact)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(compact.tobytes())])
    owners, found = [], []
    for n in range(1, most + 1):
        count = len(first) - n + 1
        if count <= 0:
            break
        whole = text_of[:count] == text_of[n - 1 :]
        runs = words if n == 1 else pc.binary_join_element_wise(*[words.slice(k, count) for k in range(n)], pa.scalar(b" ", pa.large_binary()))
        coded = runs.dictionary_encode()
        hashed = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        owners.append(text_of[:count][whole])
        found.append(hashed[coded.indices.to_numpy()][whole])
    empty = np.zeros(0, np.int64)
    return np.concatenate(owners or [empty]), np.concatenate(found or [empty]), per_text


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32)), pa.array(values, kind))


def _block(block: int, doc_ids: pa.Array, texts: pa.Array, buckets: int, most: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A block's head and its postings."""
    owner, bucket, words = features(texts, buckets, most)
    n_features = np.bincount(owner, minlength=len(texts))
    # Order: part, bucket, document.
    part = bucket % parts
    keys, counts = common.counted(((part * buckets + bucket) * len(texts)) + owner)
    docs, both = keys % len(texts), keys // len(texts)
    bucket, part = both % buckets, both // buckets
    # Totals of each bucket over the block.
    begins = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    totals = np.add.reduceat(counts, begins) if len(begins) else np.zeros(0, np.int64)
    names, per_part = np.unique(part, return_counts=True)
    _, per_seen = np.unique(part[begins], return_counts=True)
    n = len(names)
    nothing = lambda k: pa.nulls(1, pa.list_(k))
    head = [pa.array([block]), pa.array([_HEAD_PART], pa.int32()), pa.array([len(texts)], pa.int32()), *[nothing(pa.int32())] * 4, nothing(pa.int64()), pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), pa.array([n_features.tolist()], pa.list_(pa.int64())), pa.array([words.tolist()], pa.list_(pa.int64()))]
    rows = [pa.array(np.full(n, block)), pa.array(names, pa.int32()), pa.array(np.full(n, len(texts)), pa.int32()), _lists(bucket, per_part, pa.int32()), _lists(docs, per_part, pa.int32()), _lists(counts, per_part, pa.int32()), _lists(bucket[begins], per_seen, pa.int32()), _lists(totals, per_seen, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 3]
    columns = [x.split()[0] for x in _POSTINGS.split(", ")]
    yield pa.RecordBatch.from_arrays(head, columns)
    if n:
        yield pa.RecordBatch.from_arrays(rows, columns)


def _postings(batches: Iterator[pa.RecordBatch], buckets: int, most: int, parts: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().taskAttemptId() << 32
    for batch in batches:
        for a, b in tokens.blocks(batch.column("text")):
            yield from _block(block, batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a), buckets, most, parts)
            block += 1


def postings(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """Heads (part -1) and inverted postings of all blocks. Block names are a task attempt's own: write the rows before anything refers to them."""
    return common.in_batches(common.text_of(docs), partial(_postings, buckets=buckets, most=most, parts=parts), _POSTINGS)


def totals(made: DataFrame, name: str) -> DataFrame:
    """bucket and its number of features over all blocks."""
    each = made.where(F.col("part") >= 0).select(F.explode(F.arrays_zip("seen", "totals")).alias("x"))
    return each.groupBy(F.col("x.seen").alias("bucket")).agg(F.sum("x.totals").alias(name))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def _contribute(mine: pa.Table, both: pa.Table, all_s: int, all_t: int, buckets: int) -> pa.Table:
    """Contributions of a part's buckets to the documents of a slice, by block, from its postings and the buckets' totals in both corpora."""
    schema = pa.schema([("block", pa.int64()), ("sums", pa.list_(pa.int64()))])
    if not mine.num_rows:
        return schema.empty_table()
    gains = np.zeros(buckets, np.int64)
    known = both.column("bucket").to_numpy()
    gains[known] = [gain(s, t, all_s, all_t, buckets) for s, t in zip(both.column("s").to_pylist(), both.column("t").to_pylist(), strict=True)]
    flat = lambda c: pc.list_flatten(mine.column(c)).combine_chunks().to_numpy().astype(np.int64)
    per_row = np.asarray(pc.list_value_length(mine.column("docs")).to_numpy(), np.int64)
    names, row = np.unique(mine.column("block").to_numpy(), return_inverse=True)
    sizes = np.zeros(len(names), np.int64)
    sizes[row] = mine.column("size").to_numpy()
    begin = sizes.cumsum() - sizes
    at = np.repeat(begin[row], per_row) + flat("docs")
    sums = np.zeros(int(sizes.sum()), np.int64)
    np.add.at(sums, at, gains[flat("buckets")] * flat("counts"))
    return pa.Table.from_arrays([pa.array(names), _lists(sums, sizes, pa.int64())], schema=schema)


def _reduce(rows: pa.Table) -> pa.Table:
    """A block's documents with their weights, from its head and its parts' contributions."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])
    sums = None
    for value in rows.column("sums"):
        if value.is_valid:
            one = value.values.to_numpy()
            sums = one.copy() if sums is None else sums + one
    head = rows.filter(pc.is_valid(rows.column("doc_ids")))
    flat = lambda c: pc.list_flatten(head.column(c)).combine_chunks()
    n = flat("features").to_numpy()
    weight = np.where(n > 0, (np.zeros(len(n), np.int64) if sums is None else sums) // np.maximum(n, 1), 0)
    return pa.Table.from_arrays([flat("doc_ids"), pa.array(n), flat("words"), pa.array(weight, pa.int64())], schema=schema)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document; the target's rows have a text."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        made = scratch.written(postings(docs, buckets, most, parts), "postings")
        wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, most, parts)
        both = totals(made, "s").join(totals(wanted, "t"), "bucket", "full").na.fill(0, ["s", "t"])
        both = scratch.written(both, "totals")
        all_s, all_t = (x or 0 for x in both.agg(F.sum("s"), F.sum("t")).first())
        heads = made.where(F.col("part") == _HEAD_PART)
        slices = max(1, -(-heads.count() // SLICE_BLOCKS))
        rows = made.where(F.col("part") >= 0).select("block", "part", common.pick(F.xxhash64("block"), slices).alias("slice"), "size", "buckets", "docs", "counts")
        spread = both.select(F.pmod("bucket", F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "bucket", "s", "t")
        step = partial(_contribute, all_s=int(all_s), all_t=int(all_t), buckets=buckets)
        sums = rows.groupBy("part", "slice").cogroup(spread.groupBy("part", "slice")).applyInArrow(lambda a, b: step(a, b), _SUMS)
        none = F.lit(None).cast("array<long>")
        parted = sums.select("block", "sums", none.alias("doc_ids"), none.alias("features"), none.alias("words"))
        whole = parted.unionByName(heads.select("block", none.alias("sums"), "doc_ids", "features", "words"))
        return common.written(whole.groupBy("block").applyInArrow(lambda t: _reduce(t), _WEIGHTS), "weights")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Whole thousandths of Gumbel noise by doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: rank 1 is the first drawn, those not drawn have none."""
    rows = weights(docs, target, buckets, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ordering.ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")])
    shown = ["doc_id", "n_features", "weight", "score"]
    in_order = placed.select(*shown, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return in_order.unionByName(rows.where(F.col("n_words") < least_words).select(*shown, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH RECURSIVE step(i, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
dw AS (SELECT doc_id, unnest({_WORDS_SQL.format("text")}) AS w FROM documents),
bw AS (SELECT unnest({_WORDS_SQL.format("text")}) AS w FROM benchmark),
word AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bytes AS (SELECT w, list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INTEGER, 2))::BIGINT)) AS b FROM word),
bucket AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS k FROM bytes, tab),
d AS (SELECT doc_id, k, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY ALL),
s AS (SELECT k, sum(n) AS s FROM d GROUP BY 1), t AS (SELECT k, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
gain AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), total),
w AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS x FROM d JOIN gain USING (k) GROUP BY 1),
scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n_features > 0 THEN (x - ((x % n_features) + n_features) % n_features) // n_features ELSE 0 END AS BIGINT) AS weight,
           CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= n * {PERCENT} // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
