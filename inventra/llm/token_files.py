"""Operator 7: token ids in binary files, one zstandard frame a document.

A shard is two files below one folder: ``shard-NNNNNN.bin``, the frames end to end, and
``shard-NNNNNN.idx``, an index with each document's id, frame offset and token count, so that one short
document is read by one seek. All frames share one zstandard dictionary, trained on serialized id arrays
of at most SAMPLE_DOCS documents, chosen by hash (of a longer one, SAMPLE_CHARS characters from a place in it chosen by hash): the
one bounded sample. It lies in the folder, and every index carries its SHA-256. Where there is too little to train
on (fewer than about ten documents), it is empty and frames are written without one; the manifest says so.

Shards follow ascending doc_id, rows that share one by a hash of the text: Spark deals documents by range into shards of
SHARD_BYTES of text (smaller ones on small tables, to use all tasks), each task writes its own shard under a temporary name and
moves it, so a task that runs again leaves one whole file. The manifest, a table in the folder, has for each shard its numbers of
documents, ids and bytes, its first id position, whether it has a dictionary, and the tokenizer's name and hash.

Defined results: null text is empty and gives only the end id; a null doc_id sorts first; repeated
doc_ids stay as rows of their own; an empty table gives no shards and
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
SAMPLE_DOCS = 512
SAMPLE_CHARS = 20_000
SHARD_BYTES, LEAST_SHARD_BYTES = 256 << 20, 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
_MAGIC = b"TOKIDX1\n"
_HEAD = struct.Struct("<8sHH32sQ")  # magic, bytes an id, whether doc_id is there for all rows, dictionary hash, documents
_PARTS = "shard int, n_docs long, n_ids long, n_bytes long, dictionary boolean"
_MANIFEST = f"{_PARTS}, first long, tokenizer string, tokenizer_sha256 string, end_id int"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES from at most SAMPLE_DOCS documents; empty if there is too little to train on."""
    order = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("dictionary"))
    place = F.pmod(order, F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    bound = docs.select(order.alias("o")).orderBy("o").limit(SAMPLE_DOCS).agg(F.max("o")).first()[0]  # from ids alone, so that no task gathers texts that aren't chosen
    if bound is None:
        return b""
    chosen = docs.where(order <= bound).select(order.alias("o"), F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece")).orderBy("o", "piece").limit(SAMPLE_DOCS)
    texts = chosen.select("piece").toArrow().column("piece").combine_chunks()
    coder = tokens.chunk_tokenizer(tokenizer)
    kind = id_type(coder.library.get_vocab_size())
    samples = [np.append(row, end_id).astype(kind).tobytes() for row in _rows(coder, texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def _rows(coder: tokens.ChunkTokenizer, texts: pa.Array) -> Iterator[np.ndarray]:
    for a, b in tokens.blocks(texts):
        got = coder.encode(texts.slice(a, b - a))
        start = 0
        for end in got.ends.tolist():
            yield got.flat[start:end]
            start = end


def shard_name(folder: str, shard: int, kind: str) -> str:
    return f"{folder}/shard-{shard:06d}.{kind}"


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    coder, shard = tokens.chunk_tokenizer(tokenizer), TaskContext.get().partitionId()
    kind = id_type(coder.library.get_vocab_size())
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
    ids, known, offsets, counts, at = [], [], array("Q", [0]), array("Q"), 0
    system, path = common.open_fs(shard_name(folder, shard, "bin"))
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    try:
        with system.open_output_stream(own) as out:
            for batch in batches:
                for row in _rows(coder, batch.column("text")):
                    frame = press.compress(np.append(row, end_id).astype(kind).tobytes())
                    out.write(frame)
                    at += len(frame)
                    offsets.append(at)
                    counts.append(len(row) + 1)
                doc_id = batch.column("doc_id")
                ids.append(doc_id.fill_null(0).to_numpy())
                known.append(doc_id.is_valid().to_numpy(zero_copy_only=False))
    except BaseException:
        system.delete_file(own)
        raise
    if not counts:
        system.delete_file(own)
        return
    system.move(own, path)
    head = _HEAD.pack(_MAGIC, np.dtype(kind).itemsize, 1, hashlib.sha256(dictionary).digest(), len(counts))
    common.write_file(shard_name(folder, shard, "idx"), head + np.concatenate(ids).astype("<i8").tobytes() + np.packbits(np.concatenate(known)).tobytes() + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes())
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(counts)], "n_ids": [sum(counts)], "n_bytes": [at], "dictionary": [bool(dictionary)]})


class Shard:
    """One shard opened for reading: whole, or a document at a time."""

    def __init__(self, folder: str, shard: int) -> None:
        raw = common.read_file(shard_name(folder, shard, "idx"))
        magic, width, _, self.dictionary_hash, n = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError(f"not an index: {shard_name(folder, shard, 'idx')}")
        self.kind, at = f"<u{width}", _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.known = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8 * n), count=n).astype(bool)
        at += 8 * n + (n + 7) // 8
        self.offsets, self.counts = np.frombuffer(raw, "<u8", n + 1, at), np.frombuffer(raw, "<u8", n, at + 8 * (n + 1))
        dictionary = common.read_file(f"{folder}/dictionary.bin")
        if hashlib.sha256(dictionary).digest() != self.dictionary_hash:
            raise ValueError("the dictionary is not the one that the shard was written with")
        self._open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.system, self.path = common.open_fs(shard_name(folder, shard, "bin"))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the shard's document i, by one seek."""
        with self.system.open_input_file(self.path) as f:
            f.seek(int(self.offsets[i]))
            return np.frombuffer(self._open.decompress(f.read(int(self.offsets[i + 1] - self.offsets[i]))), self.kind)

    def __iter__(self) -> Iterator[np.ndarray]:
        with self.system.open_input_stream(self.path) as f:
            for size in np.diff(self.offsets).tolist():
                yield np.frombuffer(self._open.decompress(f.read(size)), self.kind)


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True):
            opened = Shard(folder, shard)
            counts = opened.counts.astype(np.int64)
            crc = np.fromiter((zlib.crc32(row.astype("<u4").tobytes()) for row in opened), np.int64, len(opened))
            yield pa.RecordBatch.from_arrays([pa.array(opened.doc_ids, pa.int64(), mask=~opened.known), pa.array(start + counts.cumsum() - counts), pa.array(counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files of all documents and the manifest; the manifest's rows, one a shard."""
    spark, docs = docs.sparkSession, common.text_of(docs)
    dictionary = train_dictionary(docs, tokenizer, end_id)
    common.write_file(f"{folder}/dictionary.bin", dictionary)
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(-(-n_bytes // SHARD_BYTES), min(common.partitions(spark), -(-n_bytes // LEAST_SHARD_BYTES)), 1)
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    step = partial(_write_shard, folder=folder, tokenizer=tokenizer, end_id=end_id, dictionary=dictionary)
    with common.Scratch(spark) as scratch:
        parts = scratch.written(common.in_batches(ranged, step, _PARTS), "parts")
        before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
        with open(tokenizer, "rb") as f:
            about = hashlib.sha256(f.read()).hexdigest()
        manifest = parts.select("*", F.coalesce(before, F.lit(0)).cast("long").alias("first"), F.lit(os.path.basename(tokenizer)).alias("tokenizer"), F.lit(about).alias("tokenizer_sha256"), F.lit(end_id).alias("end_id"))
        manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files and their manifest."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return common.in_batches(manifest.select("shard", "first").repartition(max(1, manifest.count()), "shard"), partial(_read_shards, folder=folder), _ROWS)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), folder, tokens.default_path("word_bpe_49k.json"))
    return read(spark, folder)
