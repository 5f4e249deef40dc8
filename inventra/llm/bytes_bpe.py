"""Operator 13: byte-level BPE by forced boundaries, whole texts, and its decoding.

Two neighbouring bytes that stand side by side in no entry of the vocabulary can never come into one token: every token that
spans them would hold the pair. A cut between them is certain, so the fragments between cuts are encoded
independently and their ids are put end to end. The pairs that do occur are one table of 65,536 flags.

A block of texts is worked on as flat arrays:

1. texts are cut before white space that follows something else (the split pattern never crosses that place and looks at nothing
   behind it), and the pieces are dictionary-encoded by Arrow;
2. distinct pieces of plain letters are split where the class of bytes changes, any others by the tokenizer's own split, the spelling of
   special tokens kept whole; their bytes, end to end, get the forced cuts by one look-up of all neighbouring pairs;
3. distinct fragments are merged by rank, the lowest first, the leftmost of equal ones first; a fragment is a few bytes long, and
   one of any length takes n log n steps. Each worker keeps a bounded table fragment -> ids;
4. ids of fragments are gathered to pieces and to texts.

Decoding looks each id's bytes up, joins them, and replaces what is no UTF-8, as the library does.

Memory: a block's bytes and ids. A text longer than a block is cut into blocks at certain places (step 1) where there are any.

Defined results: null text is empty and has no ids; a null doc_id stays null; repeated rows stay as they are; an empty table
gives no rows; other columns are not read. Truncation and padding that a tokenizer file may state are not applied.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, tokens
from .tokens import Ragged

#: Fragments that one worker keeps, of at most so many bytes; beyond it the table starts again empty.
MEMO_ENTRIES, MEMO_LONGEST = 300_000, 64
#: Fragments of up to so many bytes are merged by looking through all pairs again; longer ones by a heap.
SHORT = 24
#: Pieces whose split needs no more than the class of their bytes: a space or none, then letters, digits and signs. No apostrophe and no < (contractions and special tokens take the other way).
_PLAIN = r"^ ?[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-;=-@\[-`{-~]+$"
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_IDS = "doc_id long, ids array<int>"
_TEXT = "doc_id long, text string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Places (after the first byte) before ASCII white space that follows a character which is certainly none: printable ASCII, or one whose lead byte begins no white space."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(space[1:]) + 1
    one = data[at - 1]
    two = np.where(at > 1, data[np.maximum(at - 2, 0)], 0)
    three = np.where(at > 2, data[np.maximum(at - 3, 0)], 0)
    fine = ((one > 32) & (one < 127)) | ((one >= 128) & ((two >= 0xC3) & (two < 0xE0) | (two >= 128) & (two < 192) & (three >= 0xE4)))
    return at[fine]


class ByteBpe:
    """Encoder and decoder of one tokenizer file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not byte-level BPE without a prefix: {path}")
        self.split = self.library.pre_tokenizer
        byte_of = {c: b for b, c in enumerate(letters())}
        as_bytes = lambda t: bytes(byte_of[c] for c in t)
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves alone")
        self.id_of = {as_bytes(t): i for t, i in vocabulary.items() if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.merges[self.id_of[a], self.id_of[b]] = rank, self.id_of[a + b]
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], "<u4")
        self.cuts = self._cuts()
        self.table = Ragged(np.frombuffer(b"".join(self.bytes_of), np.uint8), np.array([len(t) for t in self.bytes_of], np.int64))
        self.memo: dict[bytes, bytes] = {}

    def _cuts(self) -> np.ndarray:
        """For each pair of bytes (first * 256 + second), whether no entry of the vocabulary holds it."""
        never = np.ones(1 << 16, bool)
        for token in self.id_of:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            never[b[:-1] * 256 + b[1:]] = False
        return never

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of a fragment by merges, the lowest rank first, the leftmost of equal ones first."""
        ids = self.single[np.frombuffer(fragment, np.uint8)].tolist()
        if len(ids) > SHORT:
            return self._merged_long(ids)
        merges = self.merges
        pairs = [merges.get(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not _NEVER:
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = merges.get((ids[at - 1], ids[at]), _NEVER)
            if at < len(pairs):
                pairs[at] = merges.get((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over linked places."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, made, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or merges.get((ids[i], ids[j]), (0, -1))[1] != made:
                continue  # one of its sides has been merged since
            ids[i], ids[j] = made, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*m, a))
        return [x for x in ids if x is not None]

    def _fragments(self, fragments: list[bytes]) -> list[bytes]:
        found = [self.memo.get(f) for f in fragments]
        if new := [f for f, x in zip(fragments, found, strict=True) if x is None]:
            learnt = {f: np.array(self.merged(f), "<u4").tobytes() for f in new}
            if len(self.memo) + len(new) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo.update((f, x) for f, x in learnt.items() if len(f) <= MEMO_LONGEST)
            found = [learnt[f] if x is None else x for f, x in zip(fragments, found, strict=True)]
        return found

    def _parts(self, piece: str) -> list[tuple[str | None, int]]:
        """(part in letters, 0), or (None, id) where a special token stands."""
        rest, out = piece, []
        while rest:
            where, token = min(((rest.find(t), t) for t in self.special if t in rest), key=lambda x: (x[0], -len(x[1])), default=(-1, ""))
            ordinary = rest if where < 0 else rest[:where]
            if ordinary:
                out += [(w, 0) for w, _ in self.split.pre_tokenize_str(ordinary)]
            if where < 0:
                break
            out.append((None, self.special[token]))
            rest = rest[where + len(token) :]
        return out

    def _plain(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces of plain letters: the split is where the class of bytes changes, with the space before kept to the first part."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        kind = _CLASS[data]
        starts[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        starts[bounds] = True
        return self._cut(data, starts).join(self._first(starts, bounds))

    def _others(self, pieces: list[str]) -> Ragged:
        """Ids of any distinct pieces, by the tokenizer's split."""
        parts = [self._parts(p) for p in pieces]
        flat = [x for p in parts for x in p]
        # A special token is one byte here, cut off on both sides; its id is put in at the end.
        words = [" " if w is None else w for w, _ in flat]
        special = np.fromiter((i for _, i in flat), np.int64, len(flat))
        data = _BYTES[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        bounds = np.concatenate([[0], np.fromiter(map(len, words), np.int64, len(words)).cumsum()])
        starts = np.zeros(len(data) + 1, bool)
        starts[bounds] = True
        ids, first = self._cut(data, starts), self._first(starts, bounds)
        if special.any():
            flags = np.flatnonzero(special)
            ids.flat[(ids.ends - ids.lengths)[first[flags]]] = special[flags]
        return ids.join(first).join(np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))

    @staticmethod
    def _first(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of the fragment that begins at each bound."""
        return starts.cumsum()[bounds] - 1

    def _cut(self, data: np.ndarray, starts: np.ndarray) -> Ragged:
        """Ids of the fragments of parts that lie end to end; the forced cuts join the parts' starts."""
        if len(data) > 1:
            starts[1:-1] |= self.cuts[data[:-1].astype(np.int64) * 256 + data[1:]]
        at = np.flatnonzero(starts)
        fragments = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        return Ragged.of(self._fragments(fragments.dictionary.to_pylist())).take(fragments.indices.to_numpy())

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        one, other = self._plain(pieces.filter(plain)), self._others(pieces.filter(pc.invert(plain)).to_pylist())
        where = np.empty(len(pieces), np.int64)
        where[is_plain] = np.arange(len(one.lengths))
        where[~is_plain] = len(one.lengths) + np.arange(len(other.lengths))
        return Ragged(np.concatenate([one.flat, other.flat]), np.concatenate([one.lengths, other.lengths])).take(where)

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text of a block."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        cuts = common.distinct(np.concatenate([certain_cuts(data), bounds]))
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data)).dictionary_encode()
        found = self._pieces(pieces.dictionary).take(pieces.indices.to_numpy())
        return found.join(np.searchsorted(cuts, bounds))

    def encode_long(self, text: str, most: int = tokens.BLOCK_BYTES) -> np.ndarray:
        """Ids of a text longer than a block, cut at certain places into blocks where that is possible."""
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = certain_cuts(data)
        bounds = [0]
        while bounds[-1] + most < len(data):
            near = cuts[max(0, np.searchsorted(cuts, bounds[-1] + most) - 1) :][:2]
            near = near[near > bounds[-1]]
            bounds.append(int(near[0]) if len(near) else len(data))
        bounds.append(len(data))
        return np.concatenate([self.encode(pa.array([data[a:b].tobytes().decode()])).flat for a, b in zip(bounds, bounds[1:])])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids that no token has add nothing."""
        return self.table.take(ids[ids < len(self.bytes_of)].astype(np.int64)).flat.tobytes().decode(errors="replace")


def _byte_table() -> np.ndarray:
    """From a letter of byte-level BPE (by its number) to the byte."""
    table = np.zeros(512, np.uint8)
    for b, c in enumerate(letters()):
        table[ord(c)] = b
    table[32] = 32  # the place of a special token
    return table


def _classes() -> np.ndarray:
    """The class of each byte in a plain piece."""
    table = np.full(256, _SIGN, np.uint8)
    table[32] = _SPACE
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = table[128:] = _LETTER
    return table


_BYTES, _CLASS = _byte_table(), _classes()
#: Rank of a pair that isn't merged: behind all others.
_NEVER = (1 << 40, -1)
_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One for each file and Python process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _rows(batch: pa.RecordBatch, model: ByteBpe) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a batch's rows."""
    texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
    for a, b in tokens.blocks(texts):
        block = texts.slice(a, b - a)
        if b == a + 1 and len(one := block[0].as_py() or "") > tokens.BLOCK_BYTES:
            yield doc_ids[a], model.encode_long(one)
            continue
        got, start = model.encode(block), 0
        for doc_id, end in zip(doc_ids[a:b], got.ends.tolist(), strict=True):
            yield doc_id, got.flat[start:end]
            start = end


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = byte_bpe(path)
    for batch in batches:
        found = list(_rows(batch, model))
        offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
        flat = np.concatenate([x for _, x in found]) if found else np.zeros(0, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = byte_bpe(path)
    for batch in batches:
        texts = [model.decode(np.array([] if x is None else x, np.int64)) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = byte_bpe(path)
    for batch in batches:
        out = [(d, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()) for d, ids in _rows(batch, model)]
        if out:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every document."""
    return common.in_batches(common.text_of(docs), partial(_encode, path=tokenizer), _IDS)


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    return common.in_batches(rows.select("doc_id", "ids"), partial(_decode, path=tokenizer), _TEXT)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    return common.in_batches(common.text_of(docs), partial(_digests, path=tokenizer), _DIGESTS)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
