"""Operator 10: exact duplicates by progressive refinement.

1. Rows are counted by length in bytes; only lengths of more than one row stay.
2. Rows of these lengths are counted by length and a hash of the first PREFIX characters; only pairs of more than one row stay.
3. Rows of these pairs, and no others, are read whole: their SHA-256 is computed and grouped.

The steps are the same at every size; only the way in which surviving pairs meet their rows changes. If the pairs are within
common.BROADCAST_BYTES they are broadcast, and whole texts never move: each step groups narrow rows, counted in part before each shuffle. Beyond that, a bitmap of the pairs'
hashes, which fills that bound and no more, is broadcast: a row whose bit isn't set can't survive and stays where it is; those whose bit is set are moved once to meet their pair, which decides. Pairs of
more than HOT_SHARE of all rows (so a fixed number at most) are broadcast in any case, and a group that holds a third of all rows stays where it is read. At every size only rows of surviving pairs are hashed whole;
the fuller the bitmap (a bit a pair of 33 million), the more others move.
The groups found are a few numbers a group, joined by broadcast within the same bound, else by a shuffle of the rows that were hashed.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays, a null
doc_id only where all of the group are null; rows that repeat a doc_id and its text carry the same
answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX = 64
#: Share of all rows beyond which a pair's rows aren't moved.
HOT_SHARE = 1e-3


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def refined(docs: DataFrame, prefix: int, scratch: common.Scratch) -> tuple[DataFrame, list[str], DataFrame]:
    """The rows with columns for length, prefix hash and (survivors only) whole hash; these columns' names; the groups of more than one row by them, with keep_id, copies (rows of that id) and group_size."""
    rows, names, pairs, total = _narrowed(docs, prefix, scratch)
    rows = _hashed(rows, names, pairs, total)
    return rows, names, scratch.written(_grouped(rows, names), "groups")


def _narrowed(docs: DataFrame, prefix: int, scratch: common.Scratch) -> tuple[DataFrame, list[str], DataFrame, int]:
    """The rows with length and prefix hash, the names of these columns and of the whole hash, the surviving pairs with their numbers of rows, and the number of all rows."""
    names = [common.fresh(docs, c) for c in ("length", "head", "whole")]
    length, head, _ = names
    rows = docs.withColumns({length: F.octet_length(_text()), head: F.xxhash64(F.substring(_text(), 1, prefix))})
    n = F.count(F.lit(1)).alias("n")
    counts = scratch.written(rows.groupBy(length).agg(n), "lengths")
    same_length = rows.join(common.bounded(counts.where("n > 1").select(length)), length, "left_semi")
    pairs = scratch.written(same_length.groupBy(length, head).agg(n).where("n > 1"), "heads")
    return rows, names, pairs, counts.agg(F.sum("n")).first()[0] or 0


def _hashed(rows: DataFrame, names: list[str], pairs: DataFrame, total: int) -> DataFrame:
    """The rows with the whole hash of those whose pair survives."""
    length, head, whole = names
    some = common.fresh(rows, "survives")
    pairs = pairs.select(length, head, "n", F.lit(True).alias(some))
    marked = lambda side: rows.join(side.drop("n"), [length, head], "left")
    sha = lambda df: df.withColumn(whole, F.when(F.col(some), F.unhex(F.sha2(_text(), 256)))).drop(some)
    if pairs.count() * common.BROADCAST_ROW <= common.BROADCAST_BYTES:
        return sha(marked(F.broadcast(pairs)))
    hot = F.col("n") > total * HOT_SHARE
    here = marked(F.broadcast(pairs.where(hot)))  # at most 1 / HOT_SHARE rows
    rest, slot, bits = here.where(F.col(some).isNull()).drop(some), *(common.fresh(rows, c) for c in ("slot", "bits"))
    hashed = F.xxhash64(length, head)
    slots = max(1, common.BROADCAST_BYTES // common.BROADCAST_ROW)
    place, bit = F.pmod(hashed, F.lit(slots)), F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(64)).cast("int")
    bitmap = pairs.where(~hot).select(place.alias(slot), _power(bit).alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    looked = rest.withColumn(slot, place).join(F.broadcast(bitmap), slot, "left")
    set_ = F.coalesce(F.col(bits).bitwiseAND(_power(bit)) != 0, F.lit(False))
    there = looked.where(set_).drop(slot, bits).join(pairs.where(~hot).drop("n"), [length, head], "left")
    none = looked.where(~set_).drop(slot, bits).withColumn(some, F.lit(None).cast("boolean"))
    return sha(here.where(some)).unionByName(sha(there)).unionByName(sha(none))


def _power(bit: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _grouped(rows: DataFrame, names: list[str]) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    each = rows.where(F.col(names[2]).isNotNull()).groupBy(*names, F.col("doc_id").cast("long").alias("i")).agg(n)
    last = F.max(F.struct("i", "n"))
    return each.groupBy(*names).agg(last["i"].alias("keep_id"), last["n"].alias("copies"), F.sum("n").alias("group_size")).where("group_size > 1")


def groups(docs: DataFrame, prefix: int = PREFIX, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. The last is of the row's own text, computed as it is returned.

    The rows read narrow tables of the scratch; without one, these stay in the shared folder."""
    rows, names, found = refined(common.text_of(docs), prefix, scratch or common.Scratch(docs.sparkSession))
    joined = rows.join(common.bounded(found), names, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    sha = F.coalesce(F.lower(F.hex(names[2])), F.sha2(_text(), 256))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), sha.alias("text_sha256"))


def keepers(docs: DataFrame, scratch: common.Scratch, prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat a doc_id and its text, one stays. Reads tables of the scratch."""
    rows, names, found = refined(docs, prefix, scratch)
    keep_id, copies = common.fresh(docs, "keep_id"), common.fresh(docs, "copies")
    found = found.select(*names, F.col("keep_id").alias(keep_id), F.col("copies").alias(copies))
    hashed = F.col(names[2]).isNotNull()
    alone = rows.where(~hashed).withColumns({c: F.lit(None).cast("long") for c in (keep_id, copies)})
    joined = alone.unionByName(rows.where(hashed).join(common.bounded(found), names, "left"))
    joined = joined.where(F.col(copies).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)))
    if not found.where(F.col(copies) > 1).isEmpty():
        once = joined.where(F.col(copies) > 1).dropDuplicates(names)
        joined = joined.where(F.coalesce(F.col(copies), F.lit(1)) == 1).unionByName(once)
    return joined.select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
