"""Operator 4: licence scans by a positional index of rare words.

A template is a notice (a sequence of words), the words in it that must stand consecutively (its key
phrase), its label, and the share of its words that must agree; BASE templates are their own key phrase and must agree whole. A first
pass over all documents counts in how many each template word occurs; that gives its inverse document frequency.

The index has a posting (template, place) for the rarest places of each template only: of n places of which m must
agree, any n - m + 2 hold two that do, so the n - m + 2 places of highest inverse document frequency suffice to find every match.
In a file, only words of the index are looked up. Each of their places, less the place of a posting, proposes (template,
start); starts on which two postings agree are the intersection by relative position (one for templates of a word).
There the template's other words are compared at their relative places, and a template matches if its share of words agrees
and its key phrase is there whole. The work follows from the postings of the words that occur, not from the number of templates.

The score is the largest weight of a matching template, a template's weight being its summed inverse document
frequency over the largest such sum.

Defined results: null text is empty; a file without a match has empty label strings, null places and
score 0; a match may reach over a file's ends except for its key phrase; a null doc_id stays null; repeated rows each get a row; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_BYTES = 4 << 20
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Template:
    label: str
    notice: tuple[str, ...]
    key: tuple[str, ...]
    share: float
    base: bool = False


def _base(label: str, phrase: str) -> Template:
    words = tuple(phrase.split())
    return Template(label, words, words, 1.0, True)


def _own(label: str, notice: str, key: str, share: float = 0.6) -> Template:
    return Template(label, tuple(notice.split()), tuple(key.split()), share)


#: The contract's phrases.
BASE = (_base("cc-by", "cc by"), _base("gpl", "general public license"), _base("reserved", "all rights reserved"))
#: Notices of widely used licences, and the phrase without which none of them is meant.
OWN = (
    _own("mit", "released under the mit license", "mit license"),
    _own("mit", "licensed under the mit license see license file in the project root for full license information", "under the mit license"),
    _own("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "hereby granted free of charge", 0.8),
    _own("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included in all copies or substantial portions", 0.8),
    _own("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    _own("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license", 0.8),
    _own("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "distributed under the license is distributed on an as is basis", 0.8),
    _own("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _own("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license", 0.8),
    _own("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _own("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license", 0.8),
    _own("gpl-family", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "in the hope that it will be useful", 0.8),
    _own("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    _own("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license as published", 0.8),
    _own("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    _own("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license as published", 0.8),
    _own("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _own("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _own("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    _own("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0", 0.8),
    _own("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", 0.8),
    _own("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", 0.8),
    _own("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights", 0.8),
    _own("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    _own("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain", 0.8),
    _own("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software", 0.8),
    _own("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors as is", 0.8),
    _own("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _own("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "source code form is subject to the terms", 0.8),
    _own("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted", 0.8),
    _own("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable", 0.8),
    _own("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software", 0.8),
    _own("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    _own("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license", 0.8),
    _own("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license", 0.8),
    _own("artistic-2.0", "you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license", 0.8),
    _own("odbl", "made available under the open database license", "open database license"),
    _own("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license", 0.8),
)

_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The coded words of a block, and where each text's begin."""
    texts = pc.fill_null(texts, "")
    raw = [t.as_py().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
    plain = pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends.tobytes()), pa.py_buffer(_TABLE[np.frombuffer(b"".join(raw), np.uint8)].tobytes()))
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    flat, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full).dictionary_encode(), before[offsets]


def _frequencies(batches: Iterator[pa.RecordBatch], indexed: list[str]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each batch each indexed word occurs; "" counts all documents."""
    for batch in batches:
        n = np.zeros(len(indexed), np.int64)
        for a, b in tokens.blocks(batch.column("text"), _BYTES):
            coded, offsets = words(batch.column("text").slice(a, b - a))
            number = pc.fill_null(pc.index_in(coded.dictionary, pa.array(indexed)), -1).to_numpy(zero_copy_only=False)
            found = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            at = np.flatnonzero(found >= 0)
            doc = np.searchsorted(offsets, at, side="right") - 1
            pairs = np.unique(doc * len(indexed) + found[at])
            n += np.bincount(pairs % len(indexed), minlength=len(indexed))
        yield pa.RecordBatch.from_arrays([pa.array([*indexed, ""]), pa.array([*n.tolist(), len(batch)], pa.int64())], ["word", "n"])


class Index:
    """Templates, the weights of their words, and the postings of each template's rarest places."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], documents: int) -> None:
        self.templates = templates
        self.words = sorted({w for t in templates for w in t.notice})
        number = {w: i for i, w in enumerate(self.words)}
        idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for w in self.words}
        weight = [sum(idf[w] for w in t.notice) for t in templates]
        self.weight = [w / max(weight) for w in weight]
        self.notices = [np.array([number[w] for w in t.notice]) for t in templates]
        self.phrases = [next(k for k in range(len(t.notice)) if t.notice[k : k + len(t.key)] == t.key) for t in templates]
        self.least = [math.ceil(t.share * len(t.notice)) for t in templates]
        rows = []
        for t, template in enumerate(templates):
            rarest = sorted(range(len(template.notice)), key=lambda k, n=template.notice: (-idf[n[k]], k))
            rows += [(number[template.notice[k]], t, k) for k in rarest[: len(template.notice) - self.least[t] + 2]]
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.template, self.place = rows[:, 1], rows[:, 2]
        self.ends = np.searchsorted(rows[:, 0], np.arange(len(self.words) + 1))
        self.longest = max(len(n) for n in self.notices)

    def proposals(self, number: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, start) on which two postings agree, from the words' numbers (-1: none of the index)."""
        n = np.append(np.diff(self.ends), 0)[number]
        at = np.flatnonzero(n)
        n = n[at]
        ends = n.cumsum()
        posting = np.repeat(self.ends[number[at]] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        template, where = self.template[posting], np.repeat(at, n)
        doc = np.searchsorted(offsets, where, side="right") - 1
        # A start may lie before its file's first word, so the file is part of the key.
        key = (template * len(offsets) + doc) * (len(number) + 2 * self.longest) + where - self.place[posting] + self.longest
        key, agree = common.counted(key)
        start = key % (len(number) + 2 * self.longest) - self.longest
        template = key // (len(number) + 2 * self.longest) // len(offsets)
        enough = agree >= np.minimum(2, np.array([len(x) for x in self.notices])[template])
        return template[enough], start[enough]

    def matches(self, number: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each matching template with its starts and their files."""
        template, start = self.proposals(number, offsets)
        for t in np.unique(template).tolist():
            own, notice, phrase, key = start[template == t], self.notices[t], self.phrases[t], len(self.templates[t].key)
            inside = (own + phrase >= 0) & (own + phrase + key <= len(number))
            own = np.unique(own[inside])
            doc = np.searchsorted(offsets, own + phrase, side="right") - 1
            where = own[:, None] + np.arange(len(notice))
            there = (where >= offsets[doc][:, None]) & (where < offsets[doc + 1][:, None])
            same = there & (number[np.clip(where, 0, len(number) - 1)] == notice)
            good = same[:, phrase : phrase + key].all(axis=1) & (same.sum(axis=1) >= self.least[t])
            if good.any():
                yield t, own[good], doc[good]


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    known = pa.array(index.words)
    for batch in batches:
        for a, b in tokens.blocks(batch.column("text"), _BYTES):
            coded, offsets = words(batch.column("text").slice(a, b - a))
            n = b - a
            of = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            every: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for t, start, doc in index.matches(number, offsets):
                template = index.templates[t]
                score[doc] = np.maximum(score[doc], index.weight[t])
                for d in np.unique(doc).tolist():
                    every[d].add(template.label)
                if template.base:
                    n_base += np.bincount(doc, minlength=n)
                    np.minimum.at(first, doc, start - offsets[doc])
                    np.maximum.at(last, doc, start - offsets[doc])
                    for d in np.unique(doc).tolist():
                        base[d].add(template.label)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), pa.array(np.diff(offsets)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in every], pa.string()), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def build(docs: DataFrame, templates: tuple[Template, ...] = BASE + OWN) -> Index:
    """The index, with word weights counted over all documents."""
    indexed = sorted({w for t in templates for w in t.notice})
    rows = common.in_batches(common.text_of(docs).select("text"), partial(_frequencies, indexed=indexed), "word string, n long")
    n = {r[0]: r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}
    return Index(templates, n, n.get("", 0))


def scan(docs: DataFrame, index: Index) -> DataFrame:
    return common.in_batches(common.text_of(docs), partial(_scan, index=index), _SCHEMA)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, build(docs))
