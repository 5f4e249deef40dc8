"""Operator 8: near duplicates by MinHash bands, odd sketches, and a check on full sets.

A document's set: the distinct shingles of WIDTH words of the text with A-Z lower-cased (fewer words: the
whole sequence as one), as 64-bit hashes. Two documents are linked if 100 |A n B| >= 80 |A u B|.

1. Documents with the same set are one class (grouped by a 128-bit hash of the set); its least doc_id
   stands for it from here on.
2. Each class has BANDS x ROWS MinHash samples. A band of ROWS samples is one bucket key; two sets of
   similarity 0.8 share no bucket with probability (1 - 0.8^ROWS)^BANDS, below 1e-6. All samples also fold into
   an odd sketch of BITS bits, each sample flipping one bit: the share of bits in which two sketches
   differ estimates a high similarity without either set, and candidates that differ in more bits than
   FLOOR stands for (six standard deviations above the mean at 0.8) are left out.
3. Every bucket links its members to its least one (counted in part, joined; no pairs within the bucket). What
   passes sketch and size is confirmed on the full sets, from the texts; the least one's text is sent once for every
   SALT_ROWS of its partners. The links give components.
4. Only where a bucket still holds more than one component, its members of different components
   are compared by sketch, BLOCK by BLOCK members to a task, and each such block gives a spanning forest of what passes,
   so never more edges than it has members. The trees give clusters, each document in one of them. A
   cluster's texts meet in blocks of LINK_BLOCK texts or LINK_SHINGLES shingles, where a prefix index over the block's own
   rarest shingles finds exactly the pairs that can be similar enough and its postings count what they have in common;
   confirmed links that join two components are kept. So a bucket of thousands of copies costs one confirmation each, and
   no link between different components is lost. A cluster of more than a block is read once for each of its blocks.

Nothing but counts reaches the driver. Tables of the steps are deleted as soon as the next is written; the result is a table
in the shared folder.

Defined results: texts that are null or without words have empty sets and are linked with nothing; a
row with a null doc_id is linked with nothing, its component is null and it is kept; rows that share a
doc_id are one node, with all links of all their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph, tokens

BANDS, ROWS = 48, 6
BITS = 512
PERCENT = 80
FLOOR = 0.58
#: Sketches of a block; texts and shingles of a block of a cluster; partners of a document that meet one copy of its text.
BLOCK = 8192
LINK_BLOCK, LINK_SHINGLES = 4096, 2 << 20
SALT_ROWS = 1024
_TEXT_BYTES = 2 << 20
_WORDS = BITS // 64
_SIGNATURE = "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = words.flatten().dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    void = coded.dictionary.to_pylist().index("") if "" in coded.dictionary.to_pylist() else -1
    codes = coded.indices.to_numpy()
    hashed = each[codes] if len(codes) else np.zeros(0, np.uint64)
    offsets = np.asarray(words.offsets, dtype=np.int64) - words.offsets[0].as_py()
    n = max(0, len(hashed) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = _mix(rolled + hashed[k : k + n]) if n else rolled
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(common.distinct(rolled[a : b - width + 1]))
        elif b - a == 1 and codes[a] == void or a == b:
            out.append(np.zeros(0, np.uint64))
        else:
            few = np.full(1, b - a, np.uint64)
            for h in hashed[a:b]:
                few = _mix(few + h)
            out.append(few)
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (made[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (made[n:] >> np.uint64(32)).astype(np.uint32)


def samples(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash samples, one row a set; sets are not empty."""
    factor, salt = _seeds(n)
    out = np.empty((n, len(sets)), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = 0
    while first < len(sets):  # as many sets at a time as stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(sizes[first:].cumsum(), 1 << 15, side="right")) + first)
        flat = np.concatenate(sets[first:last])
        short = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = sizes[first:last].cumsum() - sizes[first:last]
        for j in range(n):
            value = short ^ salt[j]
            value *= factor[j]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            out[j, first:last] = np.minimum.reduceat(value, starts)
        first = last
    return out.T


def odd_sketch(rows: np.ndarray) -> np.ndarray:
    """BITS parity bits of each row of samples, as 64-bit words."""
    n, k = rows.shape
    bit = _mix(rows.astype(np.uint64) << np.uint64(16) | np.arange(k, dtype=np.uint64)[None, :]) % np.uint64(BITS)
    flips = np.bincount((np.arange(n)[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<u8")


def most_differing(floor: float = FLOOR) -> int:
    """The most differing bits that two sketches of so high a similarity are expected to have."""
    return int(BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - floor) / BITS)))


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in tokens.blocks(texts, _TEXT_BYTES):
            sets = shingles(texts.slice(a, b - a), width)
            full = [s for s in sets if len(s)]
            at = np.flatnonzero([len(s) > 0 for s in sets])
            sums = np.zeros((len(sets), 2), np.int64)
            bands = np.zeros((len(sets), BANDS), np.int64)
            sketch = np.zeros((len(sets), _WORDS), np.int64)
            if full:
                flat, starts = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
                sums[at, 0] = np.add.reduceat(_mix(flat), starts).view(np.int64)
                sums[at, 1] = np.add.reduceat(_mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                rows = samples(full, BANDS * ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
                for k in range(ROWS):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k::ROWS].astype(np.uint64))
                bands[at] = key.view(np.int64)
                sketch[at] = odd_sketch(rows).view(np.int64)
            wide = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), wide(bands), wide(sketch)], ["doc_id", "n", "s1", "s2", "bands", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar enough, from rows sorted by (u, salt): u's own texts (v is null), then its partners'."""
    key, pivots = None, []
    for batch in batches:
        us, vs, salts, texts = batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("salt").to_pylist(), batch.column("text")
        out_u, out_v = [], []
        for a, b in tokens.blocks(texts, _TEXT_BYTES):
            for i, own in enumerate(shingles(texts.slice(a, b - a), width), a):
                if (us[i], salts[i]) != key:
                    key, pivots = (us[i], salts[i]), []
                if vs[i] is None:
                    pivots.append(own)
                elif any(_similar(own, other, percent) for other in pivots):
                    out_u.append(us[i])
                    out_v.append(vs[i])
        yield _edges(out_u, out_v)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. u's text goes once to each salt, not to each pair."""
    texts = docs.where(F.col("doc_id").isNotNull())
    some = common.restricted(texts, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "left_semi")
    own = pairs.select("u", "salt").distinct().join(some.withColumnRenamed("doc_id", "u"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "text")
    others = pairs.join(some.withColumnRenamed("doc_id", "v"), "v").select("u", "salt", "v", "text")
    n = common.partitions(docs.sparkSession)
    dealt = own.unionByName(others).repartition(n, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return common.in_batches(dealt, partial(_confirm, width=width, percent=percent), "u long, v long").distinct()


def _alike(percent: int) -> Column:
    """Whether sizes and sketches (n_u, n_v, sketch_u, sketch_v) let a pair be similar enough."""
    differing = sum((F.bit_count(F.col("sketch_u")[i].bitwiseXOR(F.col("sketch_v")[i])) for i in range(_WORDS)), F.lit(0))
    return (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (differing <= most_differing())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a stream that comes sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(now):
            continue
        key = [now.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            yield now.slice(x, y - x)
        rest = now.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and len(rest):
        yield rest


class _Forest:
    """Labels of a block's members; joining keeps them one a tree."""

    def __init__(self, labels: np.ndarray) -> None:
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, x: int, ys: np.ndarray) -> list[int]:
        """Joins x with all of ys; the ys that were needed for it, one a tree."""
        seen, first = np.unique(self.label[ys], return_index=True)
        needed = first[seen != self.label[x]]
        if len(needed):
            self.label[np.isin(self.label, seen)] = self.label[x]
        return ys[needed].tolist()


def _edges(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each block pair of a bucket, a spanning forest of the pairs of different components that sizes and sketches let be similar: never more edges than members."""
    most = most_differing()
    for t in _groups(batches, ["band", "i", "j"]):
        side, rep, n, component = (t.column(c).to_numpy() for c in ("side", "rep", "n", "component"))
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
        own, forest, us, vs = t.column("i")[0] == t.column("j")[0], _Forest(np.arange(len(t))), [], []
        for x in range(len(t) - 1):
            y = np.arange(x + 1, len(t))
            y = y[(component[y] != component[x]) & (forest.label[y] != forest.label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if not own:
                y = y[side[y] != side[x]]
            y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= most]
            for k in forest.join(x, y):
                us.append(int(rep[x]))
                vs.append(int(rep[k]))
        if us:
            yield _edges(us, vs)


class _Prefixes:
    """The shingles of a block's sets, each set's in the order of local rarity.

    Sets as similar as percent share a shingle of the longer prefix of the larger and of the shorter prefix
    of the smaller one, whatever the order of shingles.
    """

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        # Members and codes as 32-bit numbers: the index of a block pair is what most of a worker's memory goes to.
        of = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        code = self._coded(np.concatenate(sets))
        count = np.bincount(code).astype(np.int32)
        self.code = code[np.lexsort((code, count[code], of))]
        del code
        self.start = self.sizes.cumsum() - self.sizes
        longer = self.sizes - -(-percent * self.sizes // 100) + 1
        self.shorter = self.sizes - -(-2 * percent * self.sizes // (100 + percent)) + 1
        self.every = self._postings(self.code, of, len(count))
        place = np.arange(len(of), dtype=np.int32) - np.repeat(self.start.astype(np.int32), self.sizes)
        keep = place < longer.astype(np.int32)[of]
        self.longer = self._postings(self.code[keep], of[keep], len(count))

    @staticmethod
    def _coded(values: np.ndarray) -> np.ndarray:
        """Each value's number among the sorted distinct ones."""
        order = np.argsort(values)
        ordered = values[order]
        code = np.empty(len(values), np.int32)
        code[order] = np.cumsum(np.concatenate([np.zeros(1, bool), ordered[1:] != ordered[:-1]]), dtype=np.int32)
        return code

    @staticmethod
    def _postings(code: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return of[np.argsort(code, kind="stable")], np.concatenate([[0], np.bincount(code, minlength=n).cumsum()])

    @staticmethod
    def _meet(postings: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        of, ends = postings
        return np.concatenate([of[a:b] for a, b in zip(ends[codes].tolist(), ends[codes + 1].tolist(), strict=True)])

    def candidates(self, x: int) -> np.ndarray:
        """Sets no smaller than x that can be similar enough."""
        return np.unique(self._meet(self.longer, self.code[self.start[x] : self.start[x] + self.shorter[x]]))

    def common(self, x: int, ys: np.ndarray) -> np.ndarray:
        """How many shingles x has in common with each of ys."""
        own = self.code[self.start[x] : self.start[x] + self.sizes[x]]
        return np.bincount(self._meet(self.every, own), minlength=len(self.sizes))[ys]


def _link(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """For each block pair of a cluster, links between different components, confirmed on full sets; as many as join the components that are joined."""
    for t in _groups(batches, ["cluster", "i", "j"]):
        t = t.combine_chunks()
        texts = t.column("text").combine_chunks()
        doc, side, component = (t.column(c).to_numpy() for c in ("doc_id", "side", "component"))
        own = t.column("i")[0] == t.column("j")[0]
        sets = [s for a, b in tokens.blocks(texts, _TEXT_BYTES) for s in shingles(texts.slice(a, b - a), width)]
        index, forest, us, vs = _Prefixes(sets, percent), _Forest(component), [], []
        rank = np.empty(len(sets), np.int64)
        rank[np.argsort(index.sizes, kind="stable")] = np.arange(len(sets))
        for x in np.argsort(index.sizes, kind="stable").tolist():
            if (forest.label == forest.label[x]).all():
                break
            y = index.candidates(x)
            y = y[(rank[y] > rank[x]) & (forest.label[y] != forest.label[x]) & (percent * index.sizes[y] <= 100 * index.sizes[x])]
            if not own:
                y = y[side[y] != side[x]]
            if not len(y):
                continue
            both = index.common(x, y)
            for k in forest.join(x, y[100 * both >= percent * (index.sizes[x] + index.sizes[y] - both)]):
                us.append(int(doc[x]))
                vs.append(int(doc[k]))
        if us:
            yield _edges(us, vs)


def _block_pairs(rows: DataFrame, group: str, member: str, sizes: DataFrame) -> DataFrame:
    """Each member once for every block pair (i, j) of its group; sizes has the groups and their numbers of blocks."""
    rows = rows.join(common.bounded(sizes.select(group, F.col("blocks").cast("int").alias("blocks"))), group)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.col("own") < F.col("other")}).drop("own", "other", "blocks")
    n = common.partitions(rows.sparkSession)
    return rows.repartition(n, group, "i", "j").sortWithinPartitions(group, "i", "j")


def _clusters(shared: DataFrame, label: DataFrame, sketches: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """node, cluster of what may still be linked: members of buckets (band, rep) that hold more than one component."""
    rows = shared.select("band", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    rows = scratch.written(rows, "members")
    mixed = scratch.written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", F.ceil(F.col("c") / BLOCK).alias("blocks")), "mixed")
    dealt = _block_pairs(rows.join(common.bounded(mixed.select("band")), "band", "left_semi").join(sketches, "rep"), "band", "rep", mixed)
    edges = common.in_batches(dealt.select("band", "i", "j", "side", "rep", "n", "component", "sketch"), partial(_compare, percent=percent), "u long, v long")
    # Written, since two Python steps in one stage are two workers for each task, which stay on the executors for the rest of the job.
    edges = scratch.written(edges, "alike")
    found = graph.components(edges, scratch).withColumnRenamed("component", "cluster")
    scratch.dropped(rows, mixed, edges)
    return found


def _linked(clusters: DataFrame, label: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """Confirmed links (u, v) of different components within clusters."""
    rows = scratch.written(clusters.join(label, "node", "left").select(F.col("node").alias("doc_id"), "cluster", F.coalesce("component", "node").alias("component")), "clustered")
    n = rows.join(sketches.select(F.col("rep").alias("doc_id"), "n"), "doc_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    sizes = scratch.written(n.select("cluster", F.greatest(F.ceil(F.col("c") / LINK_BLOCK), F.ceil(F.col("n") / LINK_SHINGLES)).alias("blocks")), "sizes")
    texts = docs.where("doc_id is not null").join(common.bounded(rows), "doc_id")
    dealt = _block_pairs(texts, "cluster", "doc_id", sizes).select("cluster", "i", "j", "side", "doc_id", "component", "text")
    return scratch.written(common.in_batches(dealt, partial(_link, width=width, percent=percent), "u long, v long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = common.text_of(docs)
    with common.Scratch(docs.sparkSession) as scratch:
        signed = scratch.written(common.in_batches(docs, partial(_sign, width=width), _SIGNATURE), "signatures")
        known = signed.where("n > 0 and doc_id is not null")
        # Equal sets have equal samples, so any row's stand for the class.
        heads = scratch.written(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "heads")
        rows = scratch.written(signed.select("doc_id", "n", "s1", "s2").join(heads.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "rows")
        scratch.dropped(signed)
        # A doc_id with several texts is one node: it links the classes of its texts.
        several = scratch.written(rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi"), "several")
        same = rows.join(common.bounded(several), "doc_id").select(F.col("rep").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct()
        sketches = heads.select("rep", "n", "sketch")
        buckets = heads.select("rep", F.explode("bands").alias("band"))
        pivots = scratch.written(buckets.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("c")).where("pivot <> last").drop("last"), "pivots")
        shared = scratch.written(buckets.join(common.bounded(pivots), "band"), "buckets")
        scratch.dropped(pivots)
        side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        pairs = shared.where("rep <> pivot").groupBy(F.col("pivot").alias("u"), F.col("rep").alias("v")).agg(F.max("c").alias("c"))
        salt = F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / SALT_ROWS)).cast("int").alias("salt")
        pairs = scratch.written(pairs.join(side("u"), "u").join(side("v"), "v").where(_alike(percent)).select("u", "v", salt).distinct(), "pairs")
        first = scratch.written(confirmed(pairs, docs, width, percent).unionByName(same), "links")
        scratch.dropped(pairs)
        label = graph.components(first, scratch)
        clusters = _clusters(shared, label, sketches, percent, scratch)
        scratch.dropped(shared, first)
        second = _linked(clusters, label, sketches, docs, width, percent, scratch)
        if not second.isEmpty():
            label = graph.components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second), scratch)
        found = rows.join(label, F.col("rep") == F.col("node"), "left")
        component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))).otherwise(F.col("doc_id"))
        found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return common.written(found, "near")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)
