"""Operator 12: fill-in-the-middle transformation by a streaming matcher in constant memory.

A text's units are the matches of a pattern, left to right (by default single code points). Two ranks drawn for the document are
turned into places in two passes over a lazy iterator of matches: the first pass counts the units, which bounds the ranks; the
second goes forward to the smaller rank and on to the larger one, and stops there. Matches are never stored, so besides the text
itself a document takes the same memory whatever its length. What lies between matches belongs to the unit after it, and what
follows the last one to the suffix.

Draws: the first four groups of 8 hex digits of sha256("<seed>:<doc_id>"), h1 to h4. Prefix ends after min(h1, h2 mod units + 1) units,
middle after the larger; h3 % 100 decides whether a text is transformed, h4 % 100 between the forms:

* plain: the text as it is (always if it is empty or holds a mark itself);
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

No mark can arise where a part meets a mark, since each mark has its only ``<`` in front, so `restored` finds the parts again.

Narrow: one step over the rows where they are read. Defined results: null text is empty; a null doc_id draws as an empty one ("<seed>:");
repeated rows stay and draw alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The marks before prefix, suffix and middle.
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"(?s:.)"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
_PARTS = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"
_TEXT = "doc_id long, text string"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """h1 to h4."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def count(unit: re.Pattern, text: str) -> int:
    """Units of a text; none is kept."""
    return sum(1 for _ in unit.finditer(text))


def places(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Ends of the units of two ranks (first <= second; rank 0 ends at the start), by one pass that stops at the second."""
    matches = unit.finditer(text)

    def after(units: int, at: int) -> int:
        match = next(islice(matches, units - 1, None), None) if units else None
        return match.end() if match else at

    start = after(first, 0)
    return start, after(second - first, start)


def form_of(text: str, h3: int, h4: int) -> str:
    if not text or any(m in text for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if h4 % 100 < SPM_BELOW else "psm"


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)) if form == "spm" else prefix + middle + suffix


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    next_mark, last = output.index(two, len(one)), output.index(MIDDLE, len(one))
    a, b, middle = output[len(one) : next_mark], output[next_mark + len(two) : last], output[last + len(MIDDLE) :]
    return a + middle + b if form == "psm" else b + middle + a


def _rows(batches: Iterator[pa.RecordBatch], unit: str, seed: int) -> Iterator[tuple]:
    pattern = re.compile(unit)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            n = count(pattern, text)
            h1, h2, h3, h4 = draws(doc_id, seed)
            form = form_of(text, h3, h4)
            if form == "plain":
                yield doc_id, n, form, text, None, None
            else:
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = places(pattern, text, first, second)
                yield doc_id, n, form, text[:a], text[a:b], text[b:]


#: Characters of outputs that are gathered before they go back to Spark.
_CHUNK = 1 << 20


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (row, characters), bounded in characters."""
    held, chars = [], 0
    for row, n in rows:
        held.append(row)
        chars += n
        if chars >= _CHUNK:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _transform(batches: Iterator[pa.RecordBatch], unit: str, seed: int) -> Iterator[pa.RecordBatch]:
    def made():
        for doc_id, n, form, prefix, middle, suffix in _rows(batches, unit, seed):
            if form == "plain":
                yield (doc_id, n, form, None, None, None, prefix), len(prefix)
            else:
                output = joined(form, prefix, middle, suffix)
                yield (doc_id, n, form, prefix, middle, suffix, output), 2 * len(output)

    yield from _batches(made(), _schema(_PARTS))


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if o is None else restored(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], unit: str, seed: int) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def made():
        for doc_id, n, form, prefix, middle, suffix in _rows(batches, unit, seed):
            output = prefix if form == "plain" else joined(form, prefix, middle, suffix)
            sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
            yield (doc_id, n, form, *sizes, sha(output), sha(restored(output, form))), 256

    yield from _batches(made(), _schema(_DIGESTS))


def transform(docs: DataFrame, unit: str = UNIT, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null where plain) and output of every document."""
    return common.in_batches(common.text_of(docs), partial(_transform, unit=unit, seed=seed), _PARTS)


def restore(rows: DataFrame) -> DataFrame:
    """doc_id and text from doc_id, form and output."""
    return common.in_batches(rows.select("doc_id", "form", "output"), _restore, _TEXT)


def digests(docs: DataFrame, unit: str = UNIT, seed: int = SEED) -> DataFrame:
    """Sizes and digests of the outputs, and of the texts rebuilt from them."""
    return common.in_batches(common.text_of(docs), partial(_digests, unit=unit, seed=seed), _DIGESTS)


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS b,
             ('0x' || substr(s, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
             CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR c >= {PLAIN_FROM} THEN 'plain'
                  WHEN e < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '{PREFIX}' || left(t, p) || '{SUFFIX}' || substr(t, p + m + 1) || '{MIDDLE}' || substr(t, p + 1, m)
                        ELSE '{SUFFIX}' || substr(t, p + m + 1) || '{PREFIX}' || left(t, p) || '{MIDDLE}' || substr(t, p + 1, m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
