"""Operator 3: packing documents into windows of at most CAPACITY tokens by multiway differencing.

Each document's ids (with the end id) are cut into full windows and a rest. A full window is a sequence
of its own. The rests of a task, BLOCK of them at a time, are dealt into windows by the Karmarkar-Karp
method: every rest begins as a partial partition with one filled window; the two partial partitions of
the largest imbalance are merged again and again, the fullest windows of the one with the emptiest of the other, until
one partition is left. Its windows are nearly equal. The number of windows begins at the least that
could hold the block and rises by one whenever a window would exceed the capacity.

Nothing is shuffled: a block holds rests of one task, and the last block of a task is smaller. A
sequence's number is the task's partition and a count in it, so it is the same when a task runs again.

Defined results: null text is empty, its one piece is the end id; a null doc_id stays null; repeated rows
are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

CAPACITY = 4096
END_ID = 2
#: Rests that are dealt together.
BLOCK = 2048
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of sizes, dealt into so many windows of nearly equal sums."""
    n = len(sizes)
    # A partial partition keeps only its filled windows, the fullest first; all others are at the base of 0.
    # A window is a number: an index of sizes, or n + k for the k-th pair of windows that were put together.
    heap = [(-size if windows > 1 else 0, i) for i, size in enumerate(sizes.tolist())]
    sums, sets = dict(enumerate(sizes.reshape(-1, 1))), dict(enumerate(np.arange(n).reshape(-1, 1)))
    left, right, made = [], [], n
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y, xs, ys = sums.pop(a), sums.pop(b), sets.pop(a), sets.pop(b)
        if len(x) < len(y):
            x, y, xs, ys = y, x, ys, xs
        if len(x) + len(y) <= windows:  # the filled of each meet the empty of the other
            total, groups = np.concatenate([x, y]), np.concatenate([xs, ys])
        else:  # y's fullest meets x's emptiest, of which windows - len(x) are empty
            empty = windows - len(x)
            both = len(y) - empty
            total, groups = np.concatenate([x, y[:empty]]), np.concatenate([xs, ys[:empty]])
            at = slice(len(x) - both, len(x))
            total[at] += y[empty:][::-1]
            left.append(groups[at].copy())
            right.append(ys[empty:][::-1])
            groups[at] = np.arange(made, made + both)
            made += both
        order = np.argsort(-total, kind="stable")
        total, groups = total[order], groups[order]
        if len(total) == windows:  # only differences count: the base rises out of view
            spread = int(total[0] - total[-1])
        else:
            spread = int(total[0])
        sums[fresh], sets[fresh] = total, groups
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    if not n:
        return []
    pairs = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), strict=True)) if left else []
    return [_members(w, n, pairs) for w in sets.popitem()[1].tolist()]


def _members(window: int, n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The indices of a window, by the pairs that it was put together of."""
    found, ahead = [], [window]
    while ahead:
        w = ahead.pop()
        if w < n:
            found.append(w)
        else:
            ahead += pairs[w - n][::-1]
    return found


def deal(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most the capacity; their number rises until none exceeds it."""
    if not len(sizes):
        return []
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        groups = difference(sizes, windows)
        if max(int(sizes[g].sum()) for g in groups) <= capacity:
            return groups
        windows += 1


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, block: int) -> Iterator[pa.RecordBatch]:
    coder, sequence = tokens.chunk_tokenizer(tokenizer), TaskContext.get().partitionId() << 36
    rests: list[tuple] = []
    done: list[tuple] = []

    def settle() -> None:
        nonlocal sequence
        for group in deal(np.array([r[2] for r in rests], dtype=np.int64), capacity):
            offset = 0
            for i in group:
                done.append((*rests[i], sequence, offset))
                offset += rests[i][2]
            sequence += 1
        rests.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
        for a, b in tokens.blocks(texts):
            got = coder.encode(texts.slice(a, b - a))
            begin = 0
            for doc_id, end in zip(ids[a:b], got.ends.tolist(), strict=True):
                row = np.append(got.flat[begin:end], np.uint32(end_id))
                begin, size = end, len(row)
                for start in range(0, size, capacity):
                    piece = row[start : start + capacity]
                    part = (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), size)
                    if len(piece) == capacity:
                        done.append((*part, sequence, 0))
                        sequence += 1
                    else:
                        rests.append(part)
                if len(rests) >= block:
                    settle()
            if done:
                yield batch_of(done)
                done.clear()
    settle()
    if done:
        yield batch_of(done)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return common.in_batches(common.text_of(docs), partial(_pack, tokenizer=tokenizer, end_id=end_id, capacity=capacity, block=block), _SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"))
