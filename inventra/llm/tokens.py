"""Library tokenisation of whole texts, a block of texts at a time.

The tokenizer drops white space and its split pattern never looks across it, so the ids of a text are
the ids of its chunks between white space, in order. A block's chunks are dictionary-encoded by Arrow;
distinct chunks of plain letters are lower-cased and split by the tokenizer's own rule, also by Arrow,
and only their distinct pieces go to the library's model. Any other chunk goes through the whole
library. Each Python worker keeps a bounded table piece -> ids. Ids are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one worker keeps, of at most so many characters; beyond it the table starts again empty. Longer ones are asked for each block anew.
MEMO_ENTRIES, MEMO_LONGEST = 300_000, 64
#: Rows of a block; a block of texts and its ids are in memory together.
BLOCK_ROWS = 4096
#: Bytes of a block, but for a single longer text.
BLOCK_BYTES = 1 << 19
#: Letters whose lower case, normal form and class are the same in every Unicode version. No apostrophe and no < (contractions and added tokens take the other way).
_PLAIN = r"^[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=-@\[-`{-~]+$"
#: Fixed value: the tokenizer's own split, for such letters: single digits, runs of letters, runs of the rest.
_SPLIT = r"([0-9]|[^0-9a-zß-öø-ÿ]+)"


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


def default_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES):
    """(start, stop) of blocks of rows within the bounds."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64).cumsum()
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        stop = max(start + 1, min(start + BLOCK_ROWS, int(np.searchsorted(size, base + most, side="right"))))
        yield start, stop
        start = stop


def _strings(words: pa.Array) -> list[str]:
    """As to_pylist for words that aren't null, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Ragged:
    """Rows of ids, end to end."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths = flat, lengths
        self.ends = lengths.cumsum()

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(rows), dtype="<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4)

    def take(self, at: np.ndarray) -> Ragged:
        lengths = self.lengths[at]
        ends = lengths.cumsum()
        where = np.repeat((self.ends - self.lengths)[at] - (ends - lengths), lengths)
        where += np.arange(len(where))
        return Ragged(self.flat[where], lengths)

    def join(self, offsets: np.ndarray) -> Ragged:
        """Rows offsets[i] to offsets[i + 1] as one."""
        ends = np.concatenate([[0], self.ends])
        return Ragged(self.flat, ends[offsets[1:]] - ends[offsets[:-1]])


class ChunkTokenizer:
    """Ids of whole texts, equal to the library's ids without special tokens added."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        spec = self.library.to_str()
        # Splitting by chunks holds for a tokenizer of this shape only; any other takes texts whole.
        self.shaped = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in spec and '"Lowercase"' in spec and '"behavior":"Removed"' in spec
        self.shaped &= all(t.content.startswith("<") and " " not in t.content for t in self.library.get_added_tokens_decoder().values())
        self.pieces: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, table: dict[str, bytes], words: list[str], ask) -> list[bytes]:
        """Ids of distinct words from the table, which learns those it hasn't met."""
        found = list(map(table.get, words))
        if new := [w for w, x in zip(words, found, strict=True) if x is None]:
            if len(table) + len(new) > MEMO_ENTRIES:
                table.clear()
            learnt = dict(zip(new, ask(new), strict=True))
            table.update((w, x) for w, x in learnt.items() if len(w) <= MEMO_LONGEST)
            found = [learnt[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def _model(self, parts: list[str]) -> list[bytes]:
        """Ids of split parts by the library's model alone: normal form and split are done."""
        tokenize, table = self.model.tokenize, self.letters
        flat, ends = [], []
        for p in parts:
            flat += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(table))]
            ends.append(4 * len(flat))
        raw = np.array(flat, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _chunks(self, chunks: pa.Array) -> Ragged:
        """Ids of distinct chunks."""
        plain = pc.match_substring_regex(chunks, _PLAIN)
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _SPLIT, r" \1 ")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        coded = parts.flatten().dictionary_encode()
        pieces = Ragged.of(self._known(self.pieces, _strings(coded.dictionary), self._model)).take(coded.indices.to_numpy()).join(np.asarray(parts.offsets, dtype=np.int64))
        rest = _strings(chunks.filter(pc.invert(plain)))
        asked = Ragged.of([b"" if not w else x for w, x in zip(rest, self._known(self.others, rest, self._whole), strict=True)])
        where = np.empty(len(chunks), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        where[is_plain] = np.arange(len(pieces.lengths))
        where[~is_plain] = len(pieces.lengths) + np.arange(len(rest))
        return Ragged(np.concatenate([pieces.flat, asked.flat]), np.concatenate([pieces.lengths, asked.lengths])).take(where)

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text of a block; no text is an empty text."""
        texts = pc.fill_null(texts, "")
        if not self.shaped:
            return Ragged.of(self._whole(texts.to_pylist()))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        return self._chunks(coded.dictionary).take(coded.indices.to_numpy()).join(np.asarray(words.offsets, dtype=np.int64) - words.offsets[0].as_py())


_loaded: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer of a file for each Python process."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
