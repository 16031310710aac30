"""Byte-level BPE as a reduction over a binary tree of text pieces.

A text is halved until a piece is a leaf; leaves are encoded on their own and neighbours are
joined on the way up. Ids near the joint may be wrong, because the leaf ended there, so a window
around the joint is encoded again. The window grows on each side until it ends at a *firm* place:
a space with a non-space character on either side. No match of the split pattern reaches across
a firm place (a space only ever begins a match that holds other characters) and no look-ahead
sees past it, so the ids outside the window are those of the whole text. A side without a
firm place is encoded again completely. Decoding concatenates bytes up the same tree.

Edge cases: null and empty texts have no ids; an empty table gives an empty result; repeated rows
are encoded once each. Only the id and the text column are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, strings

LEAF = 4096  # characters
WINDOW = 32  # characters of the first window on each side

FIELDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
SCHEMA = ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
          "ids array<int>, decoded binary")
FIRM = re.compile(r"(?<=\S) (?=\S)")


class TreeEncoder:
    """Encodes and decodes texts with the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.leaf, self.window = max(1, leaf), max(3, window)
        self.encode_leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                             special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.encode_leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its two parts."""
        low, high = self._firm_before(text, start, middle), self._firm_after(text, middle, end)
        cut = self._tokens_of(reversed(left), text[low:middle])
        skip = self._tokens_of(iter(right), text[middle:high])
        return left[:len(left) - cut] + self.encode_leaf(text[low:high]) + right[skip:]

    def _firm_before(self, text: str, start: int, middle: int) -> int:
        """The last firm place of the left part, in growing windows; its start if there is none."""
        size = self.window
        while True:
            low = max(start, middle - size)
            places = [m.start() for m in FIRM.finditer(text[low:middle])]
            if places:
                return low + places[-1]
            if low == start:
                return start
            size *= 2

    def _firm_after(self, text: str, middle: int, end: int) -> int:
        size = self.window
        while True:
            high = min(end, middle + size)
            found = FIRM.search(text[middle:high])
            if found:
                return middle + found.start()
            if high == end:
                return end
            size *= 2

    def _tokens_of(self, tokens: Iterator[int], text: str) -> int:
        """How many of the tokens, from the first on, spell ``text``."""
        left, count = len(text.encode()), 0
        while left > 0:
            left -= int(self.lengths[next(tokens)])
            count += 1
        if left:
            raise AssertionError("a firm place is not a token boundary")
        return count

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> TreeEncoder:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return TreeEncoder(ranks, pattern, leaf, window)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and the ``decoded`` bytes.

    ``ranks`` is the path of a vocabulary file that every executor has.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(ranks, pattern)
        for part in batches:
            out = {k: [] for k in FIELDS.names}
            for doc_id, text in zip(part.column(0).to_pylist(), strings(part.column(1))):
                ids = tree.encode(text)
                decoded = tree.decode(ids)
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(tree.decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["ids"].append(ids if with_ids else None)
                out["decoded"].append(decoded if with_ids else None)
            yield batch(FIELDS, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = map_batches(rows, task, SCHEMA)
    return found if with_ids else found.drop("ids", "decoded")
