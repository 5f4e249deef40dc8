"""Operator 9: I-Match fingerprints, by DataFrame functions only.

A text's terms are its lower-cased runs of letters and digits, each as a 64-bit hash. The lexicon keeps
the terms whose document frequency lies in a band of shares of all documents (LOW to HIGH, at least two
documents), counted over the whole table. As each kept term lies in LOW of all documents at least, the
lexicon has at most (mean number of distinct terms of a text) / LOW entries, whatever the input's size; that
bound lets it be one constant of the plan, an array of buckets of hashes that each row looks up in place.

A document's fingerprint: its distinct lexicon terms (all its terms, if fewer than LEAST are in the
lexicon) are sorted; fixed randomised lexicon subsets, the same for all documents, each
give a hash of the document's sorted terms in the subset. There are SUBSETS of each of the RATES, each rate's within those
of the rate before: large subsets tell short documents apart, small ones hold a few terms of long ones. The likeness
of two fingerprints is taken at each rate as the share of subsets with equal hashes among those that are not empty in both documents,
if these are half of the subsets at least; the largest such share counts (at no such rate: equality of all hashes).

The edited texts need each document's successor: doc_ids are dealt into buckets by approximate
quantiles, one shuffle brings a bucket's texts together, and the first document of each next bucket
comes as a guest (a table of one row a bucket, so of a set size, is broadcast for that).

Defined results: null text is empty; texts without terms have the fingerprint "-" and are like each other with
1, like others with 0; a null doc_id sorts first; rows that repeat a doc_id follow each other by a hash
of their texts; a sole document is its own successor; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LOW, HIGH = 1e-3, 0.1
LEAST = 4
SUBSETS = 8
#: Shares of the lexicon that the subsets take, as powers of a half.
RATES = (2, 3, 4, 5, 6, 7, 8, 9, 10)
_BUCKETS = 1 << 12
_FIRST = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct term hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Column:
    """A constant: array of buckets of the hashes whose document frequency lies in the band."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n").between(max(2.0, low * n), high * n))
    table: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for h in sorted(kept.select("h").toArrow().column("h").to_pylist()):
        table[h % _BUCKETS].append(h)
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<bigint>>")


def with_print(df: DataFrame, text: str, name: str, lexicon: Column) -> DataFrame:
    """Adds the fingerprint of a text column: struct<used, parts: array<array<hash>>>, an array a subset, a hash a rate; null without a term."""
    kept = df.columns
    df = df.select(*kept, terms(F.col(text)).alias("_terms"))
    band = F.filter("_terms", lambda h: F.array_contains(F.get(lexicon, common.pick(h, _BUCKETS)), h))
    df = df.select(*kept, "_terms", band.alias("_band"))
    df = df.select(*kept, F.sort_array(F.when(F.size("_band") >= LEAST, F.col("_band")).otherwise(F.col("_terms"))).alias("_used"))

    def within(rate: int):
        """From terms and the subset's number to the terms that the subset takes at a rate."""
        return lambda rows, i: F.filter(rows, lambda h: F.xxhash64(h, i).bitwiseAND(F.lit((1 << rate) - 1)) == 0)

    # Each rate draws from the terms of the rate before, one column after the other.
    draws = [f"_draw{rate}" for rate in RATES]
    df = df.select(*kept, "_used", F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: within(RATES[0])(F.col("_used"), i)).alias(draws[0]))
    for before, draw, rate in zip(draws, draws[1:], RATES[1:], strict=False):
        df = df.select(*df.columns, F.transform(before, within(rate)).alias(draw))
    made = lambda rows: F.when(F.size(rows) > 0, F.xxhash64(rows).bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = F.transform(draws[0], lambda _, i: F.array(*[made(F.get(F.col(draw), i)) for draw in draws]))
    return df.select(*kept, F.struct((F.size("_used") > 0).alias("used"), parts.alias("parts")).alias(name))


def shown(made: Column) -> Column:
    """A fingerprint as a string: subsets joined by ":", their rates' hashes by ","."""
    subset = lambda hashes: F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",", "")
    return F.when(~made["used"], F.lit("-")).otherwise(F.array_join(F.transform(made["parts"], subset), ":"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints."""
    pairs = F.zip_with(a["parts"], b["parts"], lambda x, y: F.zip_with(x, y, lambda v, w: F.when(v.isNotNull() & w.isNotNull(), F.when(v == w, 1).otherwise(0))))

    def share(k: int) -> Column:
        met = F.filter(F.transform(pairs, lambda p: F.get(p, F.lit(k))), lambda v: v.isNotNull())
        return F.when(F.size(met) >= SUBSETS // 2, F.aggregate(met, F.lit(0), lambda x, v: x + v) / F.size(met))

    best = F.greatest(*[share(k) for k in range(len(RATES))])
    same = F.when(a["parts"] == b["parts"], 1.0).otherwise(0.0)
    return F.when(~a["used"] | ~b["used"], F.when(a["used"] == b["used"], 1.0).otherwise(0.0)).otherwise(F.coalesce(best, same))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row with the next larger doc_id (after the last: the first)."""
    spark, n = rows.sparkSession, 4 * common.partitions(rows.sparkSession)
    bounds = sorted(set(rows.select(F.percentile_approx(F.coalesce("doc_id", F.lit(_FIRST)), [i / n for i in range(1, n)], 100 * n)).first()[0] or []))
    key = F.coalesce("doc_id", F.lit(_FIRST))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key)) if bounds else F.lit(0)
    dealt = rows.select("*", key.alias("_key"), bucket.cast("int").alias("_bucket"))
    firsts = sorted(tuple(r) for r in rows.select(key.alias("_key"), bucket.cast("int").alias("_bucket")).groupBy("_bucket").agg(F.min("_key")).collect())
    if not firsts:
        return dealt.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("_key", "_bucket").limit(0)
    guests = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "_key long, _to int")
    coming = dealt.join(F.broadcast(guests), "_key").withColumn("_bucket", F.col("_to")).drop("_to").withColumn("_guest", F.lit(True))
    both = dealt.withColumn("_guest", F.lit(False)).unionByName(coming.select(*dealt.columns, "_guest"))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", F.xxhash64("text"))
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("_guest")).drop("_key", "_bucket", "_guest")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id and fingerprint of each document, the general interface."""
    docs = common.text_of(docs)
    return with_print(docs, "text", "print", lexicon(docs, low, high)).select("doc_id", shown(F.col("print")).alias("fingerprint"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = common.text_of(docs)
    terms_kept = lexicon(docs)
    rows = with_next(with_print(docs, "text", "print", terms_kept), ["text", "print"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = with_print(rows, "edited", "edited_print", terms_kept)
    made, after, following = F.col("print"), F.col("edited_print"), F.col("next_print")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(made).alias("fingerprint"),
        shown(after).alias("edited_fingerprint"),
        likeness(made, after).alias("near_edited"),
        likeness(made, following).alias("near_next"),
    )


def op9_imatch(spark, sf_dir: str) -> DataFrame:
    return with_edits(common.table(spark, sf_dir, "documents"))
