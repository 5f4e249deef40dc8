"""Operator 2: SentencePiece BPE encoding and decoding, by vectorised merge rounds.

Texts of a block are cut into units where no piece of the vocabulary could reach across: before a run
of spaces, and around characters that occur in no longer piece. The block's distinct units become one
flat array of symbols. A round looks up the rank of every neighbouring pair, takes each unit's least
rank (a segmented minimum), merges all of its places at once, leftmost first where they overlap, and
compacts the array; rounds go on until no pair is left. Merging one place at a time, as the library
does, gives the same unless a merge makes a pair of a better rank than its own; such a unit (there
must be two places at least) is done again place by place. Symbols outside the vocabulary become their
bytes' pieces.

Decoding gathers the bytes of all pieces of a block at once, turns the space mark into spaces, and
takes off the space before the first word.

Defined results: null text is empty and has no ids; a null doc_id stays null; repeated rows are encoded
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

#: Fixed value: the library's mark for a space.
SPACE = "▁"
#: Units that one worker keeps, of at most so many characters; beyond it the table starts again empty. Longer ones are merged in each block anew.
MEMO_ENTRIES, MEMO_LONGEST = 400_000, 64
_NONE = np.int64(1) << 40
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """The vocabulary as lookup tables."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = [(sp.is_control(i) or sp.is_unknown(i), sp.is_byte(i)) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.usable = {p: i for i, p in enumerate(self.pieces) if not any(kind[i])}
        order = sorted(self.usable, key=lambda p: (-sp.get_score(self.usable[p]), self.usable[p]))
        #: Rank of each id: merging begins with the best score.
        self.rank = np.full(n, _NONE)
        self.rank[[self.usable[p] for p in order]] = np.arange(len(order))
        # Pieces of equal score would be told apart by place, not by rank.
        scores = np.array([sp.get_score(self.usable[p]) for p in order])
        self.rank[[self.usable[p] for p in order]] = np.searchsorted(-scores, -scores, side="left")
        self.byte = np.full(256, -1, np.int64)
        for i in range(n):
            if kind[i][1]:
                self.byte[int(self.pieces[i][3:5], 16)] = i
        keys, ids = [], []
        for p, i in self.usable.items():
            for cut in range(1, len(p)):
                left, right = self.usable.get(p[:cut]), self.usable.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ids.append(i)
        self._fill(np.array(keys, np.int64), np.array(ids, np.int64))
        self.char = {p: i for p, i in self.usable.items() if len(p) == 1}
        inside = {c for p in self.usable if len(p) > 1 for c in p}
        # A space mark begins a unit if no piece has it behind another character.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.usable)
        self.alone = "" if "\n" in inside else "\n"
        plain = f"[^{SPACE}{self.alone}]"
        self.units = re.compile(f"{SPACE}*{plain}+|{SPACE}+|{self.alone or SPACE}")
        surface = [b"" if kind[i][0] else bytes([int(p[3:5], 16)]) if kind[i][1] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        surface[sp.unk_id()] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(s) for s in surface], np.int64)
        self.begin = self.length.cumsum() - self.length
        self.is_byte = np.array([k[1] for k in kind])
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        self.memo: dict[str, bytes] = {}

    def _fill(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Open addressing: key -> id."""
        self.bits = max(8, int(np.ceil(np.log2(4 * max(len(keys), 1)))))
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ids[at[put]] = keys[put], ids[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = left << 20 | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """One place at a time; for units where a merge makes a better pair."""
        while len(symbols) > 1:
            s = np.array(symbols, np.int64)
            made = self.merged(s[:-1], s[1:])
            ranks = np.where(made >= 0, self.rank[made], _NONE)
            k = int(ranks.argmin())
            if ranks[k] >= _NONE:
                break
            symbols[k : k + 2] = [int(made[k])]
        return symbols

    def rounds(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges until no pair is left; symbols and the unit that each is of, in order."""
        n_units = int(unit[-1]) + 1 if len(unit) else 0
        done_s, done_u = [], []
        odd: dict[int, list[int]] = {}
        begun = np.searchsorted(unit, np.arange(n_units + 1))
        source = symbols
        while len(symbols) > 1:
            made = self.merged(symbols[:-1], symbols[1:])
            made[unit[:-1] != unit[1:]] = -1
            ranks = np.where(made >= 0, self.rank[made], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            least = np.minimum.reduceat(np.append(ranks, _NONE), starts)
            live = least < _NONE
            sizes = np.diff(np.append(starts, len(unit)))
            if not live.all():  # units without a pair leave the array
                keep = np.repeat(live, sizes)
                done_s.append(symbols[~keep])
                done_u.append(unit[~keep])
                symbols, unit = symbols[keep], unit[keep]
                if not len(symbols):
                    break
                inner = keep[:-1] & keep[1:]
                where = np.cumsum(keep) - 1
                fresh_made, fresh_ranks = np.full(len(symbols) - 1, -1, np.int64), np.full(len(symbols) - 1, _NONE)
                fresh_made[where[:-1][inner]], fresh_ranks[where[:-1][inner]] = made[inner], ranks[inner]
                made, ranks, least, sizes = fresh_made, fresh_ranks, least[live], sizes[live]
                cross = unit[:-1] != unit[1:]
                made[cross], ranks[cross] = -1, _NONE
            here = (ranks == np.repeat(least, sizes)[:-1]) & (made >= 0)
            # Of neighbouring places every second one, from the left.
            place = np.flatnonzero(here)
            run = np.concatenate([[True], np.diff(place) > 1])
            run_at = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run_at) % 2 == 0]
            several = place[np.flatnonzero(np.concatenate([[False], unit[place][1:] == unit[place][:-1]]))]
            gone = np.zeros(len(symbols), bool)
            gone[place + 1] = True
            next_s = symbols.copy()
            next_s[place] = made[place]
            next_s, next_u = next_s[~gone], unit[~gone]
            if len(several):  # exact only if no merge made a pair of a better rank
                suspect = np.unique(unit[several])
                mask = np.isin(next_u, suspect)
                s, u = next_s[mask], next_u[mask]
                again = self.merged(s[:-1], s[1:])
                again[u[:-1] != u[1:]] = -1
                better = np.flatnonzero(again >= 0)
                rank_then = dict(zip(unit[place].tolist(), ranks[place].tolist(), strict=True))
                bad = sorted({int(u[k]) for k in better.tolist() if self.rank[again[k]] < rank_then[int(u[k])]})
                for k in bad:
                    odd[k] = self._one_by_one(source[begun[k] : begun[k + 1]].tolist())
                if bad:
                    stay = ~np.isin(next_u, np.array(bad))
                    next_s, next_u = next_s[stay], next_u[stay]
            symbols, unit = next_s, next_u
        done_s += [symbols, *(np.array(s, np.int64) for s in odd.values())]
        done_u += [unit, *(np.full(len(s), k, np.int64) for k, s in odd.items())]
        s, u = np.concatenate(done_s), np.concatenate(done_u)
        order = np.argsort(u, kind="stable")
        return s[order], u[order]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of each distinct unit."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        distinct, back = np.unique(points, return_inverse=True)
        ids = np.array([self.char.get(chr(p), -1 - p) for p in distinct.tolist()], np.int64)
        symbols, unit = self.rounds(ids[back], unit)
        if (symbols < 0).any():  # the bytes of characters outside the vocabulary
            spelt = {int(c): [int(self.byte[b]) for b in chr(-1 - c).encode("utf-8", "replace")] for c in np.unique(symbols[symbols < 0]).tolist()}
            rows = [spelt.get(s, [s]) if s < 0 else [s] for s in symbols.tolist()]
            unit = np.repeat(unit, np.fromiter(map(len, rows), np.int64, len(rows)))
            symbols = np.array([s for r in rows for s in r], np.int64)
        raw = symbols.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(unit, np.arange(len(units)), side="right")).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.units.findall(text) if self.cuts else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        rows = [self.cut(t) for t in texts]
        memo = self.memo
        new = list(dict.fromkeys(u for r in rows for u in r if u not in memo))
        if new and len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(dict.fromkeys(u for r in rows for u in r))
        long = {}
        for i in range(0, len(new), 1 << 17):
            for u, ids in zip(new[i : i + (1 << 17)], self.encode_units(new[i : i + (1 << 17)]), strict=True):
                (memo if len(u) <= MEMO_LONGEST else long)[u] = ids
        return [np.frombuffer(b"".join([memo[u] if u in memo else long[u] for u in r]), "<u4") for r in rows]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """UTF-8 text of each row of ids."""
        ids = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        length = self.length[ids]
        ends = length.cumsum()
        where = np.repeat(self.begin[ids] - (ends - length), length)
        where += np.arange(len(where))
        raw = self.surface[where].tobytes()
        out, at, token = [], 0, 0
        for row in rows:
            token += len(row)
            end = int(ends[token - 1]) if token else 0
            text = raw[at:end]
            if len(row) and self.spaced[row[0]]:
                text = text[1:]
            if self.is_byte[row].any():
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
            at = end
        return out


_loaded: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    spelt = [str(i).encode() for i in range(len(model.pieces))]
    for batch in batches:
        texts = batch.column("text")
        for a, b in tokens.blocks(texts):
            rows = model.encode(texts.slice(a, b - a).to_pylist())
            back = model.decode(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(b",".join([spelt[i] for i in r.tolist()])).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _encode_only(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for batch in batches:
        texts = batch.column("text")
        for a, b in tokens.blocks(texts):
            rows = model.encode(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode_only(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for batch in batches:
        rows = [np.array(r or [], np.int64) for r in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in model.decode(rows)], pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every document."""
    return common.in_batches(common.text_of(docs), partial(_encode_only, path=path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids."""
    return common.in_batches(rows.select("doc_id", "ids"), partial(_decode_only, path=path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return common.in_batches(common.text_of(docs), partial(_round_trip, path=path), _SCHEMA)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), tokens.default_path("piece_bpe_32k.model"))
