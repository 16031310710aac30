"""Packing by power-of-two decomposition.

The ids of a document are cut into pieces whose lengths are powers of two: whole ``limit`` pieces
first, then the binary digits of the remainder, longest first. Each piece is a sequence of its
own, so no sequence crosses documents and none needs padding; pieces of equal length share a
bucket, from which batches of equal shape are drawn. Packing therefore needs no shuffle at all.

Edge cases: null and empty texts give the end id alone; repeated rows are packed once each;
an empty table gives no piece. Only the id and the text column are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, utf8

LIMIT = 4096
END_ID = 2
CACHED_WORDS = 349_000  # of a generation; a dict of up to 349,525 takes no more room than one of 175,000
RUNS_SHARE = 16  # letters are remembered as words, too, so runs need only this part of the room
LONGEST_CACHED = 64  # bytes; text without blanks is one long word after the other

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, "
          "bucket int, ids binary")

FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])


# Plain words are Latin letters with at most some marks behind: a run of letters and a run of marks.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # all but the apostrophe


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters stand
    for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Remembered(dict):
    """Ids by word, remembered in two generations: a full one becomes the older one, from which words that are met again come back."""

    def __init__(self, ids_of: Callable[[bytes | str], bytes], share: int = 1):
        super().__init__()
        self.ids_of, self.older = ids_of, {}
        self.limit = max(1, CACHED_WORDS // share)

    def __missing__(self, word: bytes | str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.ids_of(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of words between white space, remembered up to a bound in words and in bytes.

    The tokenizer drops white space and never joins across it, so a text is the concatenation of
    its words. Plain words go to the merges directly; all others take the whole tokenizer. It looks for the strings of its
    special tokens before it lowers the case, so words that may hold one keep theirs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.runs = Remembered(self.run, RUNS_SHARE)
        self.words = Remembered(self.word)

    def run(self, letters: str) -> bytes:
        """Ids of one run of lower-case letters or of marks."""
        spelled = letters if letters.isascii() else "".join(map(self.letters.__getitem__, letters.encode()))
        return array("I", [t.id for t in self.merges.tokenize(spelled)]).tobytes()

    def word(self, word: bytes) -> bytes:
        """Ids of one word in lower case, or of one that holds the string of a special token."""
        stem = word.rstrip(MARKS)
        marks = word[len(stem):].decode()
        if stem.isalpha():  # of ASCII letters
            if marks:
                return self.words[stem.lower()] + self.runs[marks]
            return self.runs[word.decode().lower()]
        letters = stem.decode("utf-8", "replace")
        if not LETTERS.fullmatch(letters):
            found = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)
            return array("I", found[0].ids).tobytes()
        if marks:
            return self.words[stem] + self.runs[marks]
        return self.runs[letters.lower()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return [b"".join(map(self.words.__getitem__, self.split(text))) for text in texts]

    def split(self, text: bytes) -> list[bytes]:
        """The words of a text in lower case, which the tokenizer makes itself."""
        lowered = text.lower()
        if not any(s in lowered for s in self.special):
            return lowered.split()
        return [w if any(s in w.lower() for s in self.special) else w.lower() for w in text.split()]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def piece_lengths(total: int, limit: int = LIMIT) -> list[int]:
    """Whole ``limit`` pieces, then the binary digits of what is left, longest first."""
    lengths = [limit] * (total // limit)
    rest = total % limit
    return lengths + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`` and, if
    wanted, ``ids`` (little-endian unsigned 32-bit). ``limit`` must be a power of two.

    ``sequence_id`` numbers the pieces of the written partitions; the input must give the same
    rows when it is read again, as tables do.
    """
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = {k: [] for k in FIELDS.names}
            ids_of = word_encoder(tokenizer).encode(utf8(part.column(1)))
            for doc_id, ids in zip(part.column(0).to_pylist(), ids_of):
                ids += end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, limit):
                    piece = ids[4 * start:4 * (start + length)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(total)
                    out["offset"].append(0)
                    out["bucket"].append(length.bit_length() - 1)
                    out["ids"].append(piece if with_ids else None)
                    start += length
            yield batch(FIELDS, out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = map_batches(rows, task, SCHEMA).withColumn("sequence_id", F.monotonically_increasing_id())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return pieces.select(*columns, *(["ids"] if with_ids else []))
