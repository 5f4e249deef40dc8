"""Operator 1: language identification by bit-sliced Bloom filters of n-grams.

A text is lower-cased and its bytes that are neither a-z nor part of a longer character become word
ends. Its n-grams are the windows of 3 and of 4 bytes that hold no word end inside. A bit-sliced filter is
an array of rows of bitmasks, a bit for each language (as many 32-bit words a row as the languages need): an n-gram's HASHES
positions are read and joined by AND, which gives all languages that contain it at once. A language contains an n-gram if the n-gram makes
up at least SHARE of the language's n-grams and at least RATIO of the largest such share, so there are at most
2 / SHARE insertions a language. The filter has ROWS_EACH rows (a power of two) for each n-gram of the language that has the most, at
least LEAST_ROWS: 16 million rows and 64 MB for each 32 languages at most, whatever the input's size, which is what
makes it fit to broadcast. Counts cover all training documents; they are added up in part within each task, and tasks
set the filter's bits, a block of rows each.

For each document and language the popcount h of n windows is corrected for the filter's false
positives, (h - n f) / (1 - f) with f the language's filled share of rows to the power of HASHES. The
largest wins (ties: the first in alphabetical order); its lead over the sum of the two largest is the score, and its share of the
windows the coverage.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text with letters but no
known n-gram takes the most frequent learnt language with score 0; without any training document all are
``und``; a null doc_id counts as the empty string for the folds; repeated rows each get a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

ROWS_EACH, LEAST_ROWS = 8, 1 << 16
HASHES = 2
SHARE = 1e-6
RATIO = 0.25
ORDERS = (3, 4)
#: Rows of the filter that one task sets together.
ROW_BLOCK = 1 << 15
#: Bytes of text whose windows are in memory together.
BLOCK = 1 << 19
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def held_out() -> Column:
    """Whether a document is held out: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: keys of all windows, and the text that each is of."""
    raw = [b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    data = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    of = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter(map(len, raw), np.int64, len(raw)))
    end = data == 0x20
    wide = data.astype(np.uint64)
    for order in ORDERS:
        n = len(data) - order + 1
        key = np.full(n, order, np.uint64)
        inside = np.zeros(n, bool)
        for k in range(order):
            key = key << np.uint64(8) | wide[k : k + n]
            if 0 < k < order - 1:
                inside |= end[k : k + n]
        keep = np.flatnonzero(~inside)
        yield key[keep], of[keep]


def positions(keys: np.ndarray, rows: int) -> list[np.ndarray]:
    """HASHES rows of each key; rows is a power of two."""
    mixed, out = keys.astype(np.uint64), []
    for _ in range(HASHES):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(32)).astype(np.int64) & (rows - 1))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = pa.array(texts[langs == lang].tolist(), pa.string())
            for a, b in tokens.blocks(own, BLOCK):
                for keys, _ in windows(own.slice(a, b - a).to_pylist()):
                    key, n = common.counted(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "key", "n"])


class Filter:
    """The bit-sliced filter (a row of words for each position) and what scoring needs beside it."""

    def __init__(self, langs: list[str], usual: str, masks: np.ndarray) -> None:
        self.langs, self.usual, self.masks = langs, usual, masks
        self.false = np.minimum(np.array([self.bit(masks, i).mean() if len(masks) else 0.0 for i in range(len(langs))]) ** HASHES, 0.999)

    @staticmethod
    def bit(found: np.ndarray, language: int) -> np.ndarray:
        return (found[:, language // 32] >> np.uint32(language % 32)) & np.uint32(1)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        first, *rest = positions(keys, len(self.masks))
        out = self.masks[first]
        for p in rest:
            out &= self.masks[p]
        return out

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        hits, total = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        for keys, of in windows(texts):
            found = self.containing(keys)
            total += np.bincount(of, minlength=len(texts))
            for i in range(len(self.langs)):
                hits[i] += np.bincount(of[self.bit(found, i) == 1], minlength=len(texts))
        letters = np.array([any(map(str.isalpha, t)) for t in texts])
        corrected = np.maximum((hits - total * self.false[:, None]) / (1 - self.false[:, None]), 0)
        best = corrected.argmax(axis=0)
        ranked = np.sort(corrected, axis=0)
        top, second = ranked[-1], ranked[-2] if len(self.langs) > 1 else np.zeros(len(texts))
        score = np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)
        pred = [(self.langs[b] if t > 0 else self.usual) if known else UNKNOWN for b, t, known in zip(best.tolist(), top.tolist(), letters.tolist(), strict=True)]
        return pred, np.where(letters, score, 0.0), np.where(letters, top / np.maximum(total, 1), 0.0)


def _positions(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The bits to set: block and row within it, word and bit."""
    for batch in batches:
        key, number = batch.column("key").to_numpy(), batch.column("number").to_numpy()
        at = np.concatenate(positions(key, rows))
        number = np.tile(number, HASHES)
        yield pa.RecordBatch.from_arrays([pa.array((at // ROW_BLOCK).astype(np.int32)), pa.array((at % ROW_BLOCK).astype(np.int32)), pa.array(number.astype(np.int32))], ["block", "at", "number"])


def _blocks_of_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The filter's rows of each block, from rows sorted by block."""
    made = lambda block, mask: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mask.tobytes()], pa.binary())], ["block", "masks"])
    block, mask = None, None
    for batch in batches:
        of, at, number = (batch.column(c).to_numpy() for c in ("block", "at", "number"))
        for b in np.unique(of).tolist():
            if b != block:
                if mask is not None:
                    yield made(block, mask)
                block, mask = b, np.zeros((ROW_BLOCK, words), np.uint32)
            own = of == b
            np.bitwise_or.at(mask, (at[own], number[own] // 32), np.uint32(1) << (number[own] % 32).astype(np.uint32))
    if mask is not None:
        yield made(block, mask)


def fit(docs: DataFrame) -> Filter:
    """The filter of all rows with a language and a text."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    with common.Scratch(spark) as scratch:
        counts = scratch.written(common.in_batches(rows, _count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
        totals = dict(sorted((r[0], r[1]) for r in counts.groupBy("lang").agg(F.sum("n")).collect()))
        if not totals:
            return Filter([], UNKNOWN, np.zeros((0, 1), np.uint32))
        numbers = common.few(spark, [(name, i, float(n)) for i, (name, n) in enumerate(totals.items())], "lang string, number int, total double")
        shares = counts.join(common.bounded(numbers), "lang").select("key", "number", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= SHARE)
        most = shares.groupBy("key").agg(F.max("share").alias("most"))
        kept = scratch.written(shares.join(most, "key").where(F.col("share") >= RATIO * F.col("most")).select("key", "number"), "kept")
        largest = kept.groupBy("number").count().agg(F.max("count")).first()[0] or 0
        n_rows, words = max(LEAST_ROWS, 1 << int(ROWS_EACH * largest - 1).bit_length()) if largest else LEAST_ROWS, -(-len(totals) // 32)
        bits = common.in_batches(kept, partial(_positions, rows=n_rows), "block int, at int, number int").distinct()
        dealt = bits.repartition(common.partitions(spark), "block").sortWithinPartitions("block")
        masks = np.zeros((n_rows, words), np.uint32)
        for r in common.in_batches(dealt, partial(_blocks_of_rows, words=words), "block int, masks binary").toLocalIterator():  # the filter itself, of the bounded size
            masks[r[0] * ROW_BLOCK : (r[0] + 1) * ROW_BLOCK] = np.frombuffer(r[1], np.uint32).reshape(-1, words)
    return Filter(list(totals), max(totals, key=lambda k: (totals[k], k)), masks)


def predict(docs: DataFrame, fitted: Filter) -> DataFrame:
    """doc_id, text_hash, held_out, lang_pred, score, coverage of every row; only texts are read for the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    through = ("doc_id", "text_hash", "held_out")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in tokens.blocks(texts, BLOCK):
                pred, score, coverage = sent.value.score(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in through), pa.array(pred, pa.string()), pa.array(score), pa.array(coverage)], [*through, "lang_pred", "score", "coverage"])
        vars(sent).pop("_value", None)  # the worker stays, idle or for other work; the next task reads the filter again

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out")).withColumn("text_hash", F.xxhash64("text"))
    return common.in_batches(rows, step, "doc_id long, text_hash long, held_out boolean, lang_pred string, score double, coverage double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out())))
