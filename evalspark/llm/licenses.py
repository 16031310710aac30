"""License scans by conditional compression.

Words that license texts cannot do without point at candidate blocks, anywhere in the text. A block is compressed
alone and once with every template as a zstandard raw dictionary; the more a template shortens the block, the
more of its wording the block holds. Templates are tried in the order of that saving, and one is confirmed by the exact word
differences between it and the best matching stretch of the block: at most one word in ten may be missing, added or changed
(one in a short notice), and never a word that names the license, such as its version, nor a word between two such words.
Texts that several licenses share are named after all of them, unless the words that follow tell which one it is. Every stretch of a block that
is confirmed counts, so repeated notices are all found, however near they are. Of overlapping findings
the one with fewer differences per word stays, then the longer.

Edge cases: null and empty texts have no finding; repeated rows are scanned once each; empty tables give an
empty result. Only the id and the text column are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, utf8

# Wordings that several licenses begin with.
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
          "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:")
_CONDITIONS = (_OPENING + " Redistributions of source code must retain the above copyright notice, this list of conditions and the "
               "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
               "and the following disclaimer in the documentation and/or other materials provided with the")
# Common notices and grants, the words that name the license in braces.
TEMPLATES = (
    ("MIT", "Released under the {MIT} License."),
    ("MIT", "Licensed under the {MIT} License."),
    ("MIT", _GRANT + ", and to permit persons to whom the Software is furnished to do so, {subject to the following conditions}"),
    ("MIT-0", _GRANT + ", and to permit persons to whom the Software is furnished to do {so. THE SOFTWARE IS PROVIDED} \"AS IS\""),
    ("MIT OR MIT-0", _GRANT),
    ("Apache-2.0", "Licensed under the {Apache} License, Version {2.0}."),
    ("Apache-2.0", "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-2.0", "This work is licensed under the {GNU General} Public License, version {2}."),
    ("GPL-3.0", "This work is licensed under the {GNU General} Public License, version {3}."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General} "
                "Public License as published by the Free Software Foundation; either version {2} of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General} "
                "Public License as published by the Free Software Foundation, either version {3} of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Library General} "
                 "Public License as published by the Free Software Foundation; either version {2} of the License, or (at your "
                 "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General} "
                 "Public License as published by the Free Software Foundation; either version {2.1} of the License, or (at your "
                 "option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General} "
                 "Public License as published by the Free Software Foundation, either version {3} of the License, or (at your "
                 "option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General} "
                 "Public License as published by the Free Software Foundation, either version {3} of the License, or (at your "
                 "option) any later version."),
    ("LGPL-2.1", "This work is licensed under the {GNU Lesser General} Public License, version {2.1}."),
    ("LGPL-3.0", "This work is licensed under the {GNU Lesser General} Public License, version {3}."),
    ("AGPL-3.0", "This work is licensed under the {GNU Affero General} Public License, version {3}."),
    ("BSD-2-Clause", _CONDITIONS + " {distribution. THIS SOFTWARE IS PROVIDED} BY"),
    ("BSD-3-Clause", _CONDITIONS + " distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "{endorse or promote} products derived from this software without specific prior written permission."),
    ("BSD-2-Clause OR BSD-3-Clause OR BSD-4-Clause", _OPENING),
    ("BSD-3-Clause", "Released under the {BSD} License."),
    ("BSD-2-Clause", "Released under the {BSD 2-Clause} License."),
    ("BSD-2-Clause", "Released under the {2-Clause BSD} License."),
    ("BSD-3-Clause", "Released under the {BSD 3-Clause} License."),
    ("BSD-3-Clause", "Released under the {3-Clause BSD} License."),
    ("ISC", _FEE + ", {provided that the above copyright notice} and this permission notice appear in all copies."),
    ("0BSD", _FEE.replace("granted", "{granted. THE SOFTWARE IS PROVIDED} \"AS IS\"")),
    ("0BSD OR ISC", _FEE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}."),
    ("CC-BY-4.0", "Licensed under {CC BY 4.0}."),
    ("CC-BY-SA-4.0", "Licensed under {CC BY-SA 4.0}."),
    ("CC-BY-NC-4.0", "Licensed under {CC BY-NC 4.0}."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons {Attribution 4.0} International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons {Attribution-NonCommercial 4.0} International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Every template holds one of these.
ANCHORS = (b"license", b"licence", b"hereby granted", b"redistribut", b"copyright and related", b"public domain", b"licensed under cc")

WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+(?:[.\-/][A-Za-z0-9\x80-\xff]+)*")
LEVEL = 3
MARGIN = 6  # words around the longest stretch that a template can cover
ALLOWED = 0.1  # differing words per word of a template


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[bytes, ...]
    naming: frozenset[int]  # places of the words that must not differ
    raw: bytes
    joined: frozenset[int] = frozenset()  # those of them after which no word may come in

    @property
    def shared(self) -> bool:
        """Several licenses have this wording."""
        return " OR " in self.license

    @property
    def allowed(self) -> int:
        return max(1 if len(self.words) >= 5 else 0, int(ALLOWED * len(self.words)))


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    out = []
    for name, text in TEMPLATES:
        plain = text.replace("{", "").replace("}", "").encode()
        naming, joined, place = set(), set(), 0
        for depth, piece in enumerate(re.split("[{}]", text)):
            count = len(WORD.findall(piece.encode()))
            if depth % 2:
                naming.update(range(place, place + count))
                joined.update(range(place, place + count - 1))
            place += count
        words = tuple(w.lower() for w in WORD.findall(plain))
        if place != len(words):
            raise ValueError(f"braces cut a word: {text}")
        out.append(Template(name, words, frozenset(naming), plain.lower(), frozenset(joined)))
    return tuple(out)


class Scanner:
    """Compressors for all templates, and blocks already judged."""

    LIMIT = 20_000

    def __init__(self):
        self.templates = templates()
        self.reach = max(len(t.words) for t in self.templates) + MARGIN
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = []
        for t in self.templates:
            rules = zstandard.ZstdCompressionDict(t.raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            rules.precompute_compress(level=LEVEL)
            self.given.append(zstandard.ZstdCompressor(dict_data=rules, write_dict_id=False))
        self.judged: dict[bytes, list[tuple[int, int, int, int, int]]] = {}

    def findings(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """``license, start, end, saved bytes, differing words`` with byte offsets."""
        lower = text.lower()
        anchors = list({at for word in ANCHORS for at in _places(lower, word)})
        heapq.heapify(anchors)
        out, covered, last = [], 0, -1
        while anchors:
            at = heapq.heappop(anchors)
            if at < covered or at == last:
                continue
            last = at
            low, high = self._block(lower, at)
            low = max(low, covered)
            for index, start, end, saved, differing in self._judge(lower[low:high]):
                if low + start > at:
                    heapq.heappush(anchors, low + start)  # the block may end too early for it
                    break
                out.append((self.templates[index].license, low + start, low + end, saved, differing))
                covered = low + end
        return out

    def _block(self, text: bytes, at: int) -> tuple[int, int]:
        """The words around an anchor that a template could cover; white space is all that is skipped to count them."""
        low, high = at, at
        for _ in range(self.reach):
            low = _word_before(text, low)
        for _ in range(self.reach):
            high = _word_after(text, high)
        return low, high

    def _judge(self, block: bytes) -> list[tuple[int, int, int, int, int]]:
        known = self.judged.get(block)
        if known is None:
            if len(self.judged) >= self.LIMIT:
                self.judged.clear()
            known = self.judged[block] = self._confirmed(block)
        return known

    def _confirmed(self, block: bytes) -> list[tuple[int, int, int, int, int]]:
        size = len(self.alone.compress(block))
        savings = sorted(((size - len(c.compress(block)), -i) for i, c in enumerate(self.given)), reverse=True)
        spans = [(m.start(), m.end()) for m in WORD.finditer(block)]
        words = [block[a:b] for a, b in spans]
        hits = []
        for saved, minus in savings:
            if saved <= 0:
                break
            template = self.templates[-minus]
            for differing, first, last in stretches(template, words):
                hits.append((template.shared, differing / len(template.words), -(last - first), -saved, -minus, spans[first][0], spans[last][1], differing))
        out: list[tuple[int, int, int, int, int]] = []
        for *_, saved, index, start, end, differing in sorted(hits):
            if all(end <= s or e <= start for _, s, e, _, _ in out):
                out.append((index, start, end, -saved, differing))
        return sorted(out, key=lambda x: x[1])


def _places(text: bytes, word: bytes) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


SPACE = frozenset(b" \t\n\r\x0b\x0c")
LONGEST_WORD = 64  # bytes after which a run without white space counts as a word of its own


def _word_before(text: bytes, at: int) -> int:
    while at > 0 and text[at - 1] in SPACE:
        at -= 1
    stop = max(0, at - LONGEST_WORD)
    while at > stop and text[at - 1] not in SPACE:
        at -= 1
    return at


def _word_after(text: bytes, at: int) -> int:
    while at < len(text) and text[at] in SPACE:
        at += 1
    stop = min(len(text), at + LONGEST_WORD)
    while at < stop and text[at] not in SPACE:
        at += 1
    return at


def best_stretch(template: Template, words: list[bytes]) -> tuple[int, int, int] | None:
    """The stretch of ``words`` with the fewest word insertions, deletions and changes against the template:
    ``(differences, first word, last word)``, or None if there are too many or a naming word differs."""
    far = 1 << 20
    width = len(words) + 1
    cost = np.zeros(width, np.int64)  # a stretch may begin anywhere
    begin = np.arange(width)
    spots = np.arange(width)
    for place, want in enumerate(template.words):
        named = place in template.naming
        same = np.array([w == want for w in words], bool)
        drop = cost + (far if named else 1)  # the template's word is missing
        move = np.full(width, far * 4, np.int64)
        move[1:] = cost[:-1] + np.where(same, 0, far if named else 1)
        pick = move <= drop
        now = np.where(pick, move, drop)
        start = np.where(pick, np.r_[0, begin[:-1]], begin)
        if place in template.joined:  # no extra word
            cost, begin = now, start
            continue
        # an extra word in the text: the running minimum of cost minus place
        order = now - spots
        least = np.minimum.accumulate(order)
        source = np.maximum.accumulate(np.where(order == least, spots, 0))
        cost, begin = least + spots, start[source]
    end = int(cost.argmin())
    if cost[end] > template.allowed or end == 0 or begin[end] >= end:
        return None
    return int(cost[end]), int(begin[end]), end - 1


def stretches(template: Template, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """The best stretch, and those in the words before and after it."""
    left = [(0, len(words))]
    while left:
        low, high = left.pop()
        held = set(words[low:high])
        if high - low < len(template.words) - template.allowed or sum(w not in held for w in template.words) > template.allowed:
            continue
        match = best_stretch(template, words[low:high])
        if match:
            differing, first, last = match
            yield differing, low + first, low + last
            left += [(low, low + first), (low + last + 1, high)]


FIELDS = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("saved_bytes", pa.int64()), ("differing_words", pa.int64()), ("wording", pa.string())])
SCHEMA = "doc_id bigint, license string, start bigint, `end` bigint, saved_bytes bigint, differing_words bigint, wording string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: ``doc_id, license, start, end, saved_bytes, differing_words, wording``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in batches:
            out = {f.name: [] for f in FIELDS}
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                for name, start, end, saved, differing in scanner.findings(text):
                    wording = text[start:end].decode("utf-8", "replace")
                    first = len(text[:start].decode("utf-8", "replace"))
                    for field, value in zip(FIELDS.names, (doc_id, name, first, first + len(wording), saved, differing, wording)):
                        out[field].append(value)
            yield batch(FIELDS, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, task, SCHEMA)
