"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when ``100 * intersection >= percent * union`` of their sets of word n-grams.
The product of the incidence matrix with its transpose holds all intersections; only the entries
that can reach the threshold are computed.

*Column blocks.* The sizes of two linked sets lie within ``percent`` of each other, and the sets differ
in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes. Sets are therefore put
into size bands; a band compares with itself and the next one, and has a number of column blocks
above the largest difference that its sizes allow. An n-gram falls into a block by its hash. Two
linked rows must then agree entirely on at least one block, so a row is looked up by the
signatures of its blocks. (Blocks empty in both rows also agree: a band has spare blocks for them, and a
row with more empty blocks than the bound allows also emits those.) Most rows must agree on more than one: a row that shares fewer
signatures with others than its size asks for links with nobody and is left out, before the hub round and again after it.

*Row blocks.* Equal sets are merged first. Then one hub round: every group of rows with a common signature
multiplies one of its rows with the others, which finds most components at little cost. Rows whose group still
spans several components are gathered into families, the connected parts of "has a signature in common" within
a band. A family is the sparse matrix of its rows, dealt to blocks of bounded size by rows. Short sketches (one byte per fine column block)
give a lower bound of the differences in a block and leave out the rows that link with nobody in it. A block task then holds the n-gram sets of
two parts and forms their product: columns that a single row holds are left out, the others are multiplied
column block by column block and the overlap counts accumulated, and after each column block the pairs are discarded
that can no longer reach their size-derived bound, and rows without any pair left. Of the pairs that link, a block returns only
what spans its components, at most one link per component of the hub round. No pair of a family is ever written, joined or left
out, so components are exact, up to equal 64-bit hashes.

Scale: signatures are about ``2.3 * (100 - percent) / (100 + percent)`` per n-gram, dealt to packed
buckets whose number follows the bytes of text; a signature enters its bucket at most once per writing task, so copies
do not pile up. Everything after that is grouping and joins over repeated signatures only. A family's rows travel once per block they
are part of (once, up to 512 rows and half a million n-grams); the work on pairs of a larger family is spread over its blocks.

Edge cases: a document without words or with null text has an empty set and links with nothing; one with
fewer than n words has its whole sequence as one n-gram; repeated rows and equal ids are merged like copies;
a null id never is the smallest of its component unless all are null; an empty table gives an empty result.
Only the id and the text column are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.skew import lookup
from evalspark.llm.common import WordHashes, batch, map_batches, utf8, words_of
from evalspark.llm.graph import components
from evalspark.session import new_path, run_folder, stage, tidy

FLUSH = 1_000_000  # signatures a task gathers before it packs them
TEXT_PER_BUCKET = 64_000_000  # bytes of text whose signatures meet in one bucket
COLUMN_BLOCKS = 8  # steps in which a single pair of rows is multiplied
COLUMNS = 2048  # columns of a family that are multiplied at once
PACK_LEVEL = 3  # of the words of a set
SKETCH_BLOCKS = 2  # bytes of a sketch per row of difference that a band allows
FAMILY_ROWS, FAMILY_GRAMS = 512, 1 << 19  # rows and n-grams of a part of a family
NOBODY = -(1 << 63)  # stands for a missing id where rows are chosen
FILTER_BITS = 1 << 24  # of the filter on the rows whose sets are needed

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)

PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
BUCKETED = pa.schema([(name, pa.int64()) for name in ("sig", "cls", "doc_id", "n", "band", "own", "above")])
SETS = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("band", pa.int32()), ("own", pa.binary()), ("above", pa.binary()),
                  ("words", pa.binary())])


@dataclass(frozen=True)
class Rule:
    """What links two documents: sets of ``words``-word n-grams at ``percent`` or more Jaccard."""

    words: int = 5
    percent: int = 80

    def difference(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def needed(self, a: int, b: int) -> int:
        """The smallest intersection that links sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * MIX
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _bands(rule: Rule, upto: int) -> tuple[list[int], list[int]]:
    """First size of each band, and its number of column blocks, as far as size ``upto`` and one band more."""
    low, blocks = [], []
    first = 1
    while True:
        last = rule.largest_partner(first)
        most = rule.difference(2 * last)
        count = most + 1
        if most:
            for _ in range(4):  # spare blocks for those that are empty in both rows
                empty = count * math.exp(-last / count)
                count = most + 1 + math.ceil(empty + 3 * math.sqrt(empty))
        low.append(first)
        blocks.append(count if most else 0)
        if first > upto:
            return low, blocks
        first = last + 1


def shingles(text: bytes, rule: Rule, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams of a text."""
    words = hashes.of(words_of(text))
    if not len(words):
        return words
    width = min(rule.words, len(words))
    out = words[:len(words) - width + 1].copy()
    for step in range(1, width):
        out = mixed(out) + words[step:len(words) - width + 1 + step]
    return np.unique(mixed(out + np.uint64(width)))


def packed_words(text: bytes) -> bytes:
    """The words of a text, compressed: a third of its size in n-gram hashes, which ``Unpacked`` makes again."""
    return zstandard.compress(b" ".join(words_of(text)), PACK_LEVEL)


class Unpacked:
    """The n-grams of packed words; those of the last ones on each side are remembered, since a hub meets many rows in turn."""

    def __init__(self, rule: Rule):
        self.rule, self.hashes, self.last = rule, WordHashes(), {}

    def of(self, words: bytes, side: int = 0) -> np.ndarray:
        known, grams = self.last.get(side, (None, None))
        if words != known:
            grams = shingles(zstandard.decompress(words), self.rule, self.hashes)
            self.last[side] = words, grams
        return grams


def class_of(grams: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def signatures(grams: np.ndarray, rule: Rule) -> np.ndarray:
    """The names under which a row can meet every row it links with, other than equal ones."""
    return signatures_and_needs(grams, rule)[0]


def signatures_and_needs(grams: np.ndarray, rule: Rule) -> tuple[np.ndarray, list[int]]:
    """The names under which a row can meet the rows it links with, and how many of them, at least, it shares with each
    of those in its own band and in the one above.

    Rows that differ in d n-grams agree on all blocks but d, and at most the row's own empty blocks have no name.
    """
    size = len(grams)
    low, blocks = _bands(rule, 1 << max(4, size.bit_length()))
    own = int(np.searchsorted(low, size, "right")) - 1
    out, needs = [], []
    for band in (own, own + 1):
        count = blocks[band]
        if not count:
            needs.append(1)
            continue
        part = (grams % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, part, mixed(grams))
        full = np.bincount(part, minlength=count) > 0
        last = low[band + 1] - 1 if band + 1 < len(low) else rule.largest_partner(low[band])
        agreed = count - rule.difference(size + min(last, rule.largest_partner(size)))
        empty = count - int(full.sum())
        if empty >= agreed:
            full[:] = True  # empty blocks could be all that it shares with a row it links with
        needs.append(max(1, agreed - empty))
        at = np.flatnonzero(full).astype(np.uint64)
        names = mixed(sums[full] + mixed(at + np.uint64(band << 40) + np.uint64(1)))
        out.append(names & ~np.uint64(1) | np.uint64(band & 1))  # the last bit tells the two bands of a row apart
    return np.concatenate(out) if out else np.zeros(0, np.uint64), needs


def band_of(size: int, rule: Rule) -> int:
    low, _ = _bands(rule, 1 << max(4, size.bit_length()))
    return int(np.searchsorted(low, size, "right")) - 1


def block_bytes(grams: np.ndarray, band: int, rule: Rule) -> bytes:
    """One byte per fine column block, for comparing rows within a band; rows that differ in d n-grams differ in at
    most d bytes."""
    low, _ = _bands(rule, 1 << max(4, len(grams).bit_length()))
    last = low[band + 1] - 1 if band + 1 < len(low) else rule.largest_partner(low[band])
    count = max(8, SKETCH_BLOCKS * (rule.difference(2 * last) + 1))
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, ((grams >> np.uint64(24)) % np.uint64(count)).astype(np.int64), mixed(grams + np.uint64(1)))
    return (mixed(sums) >> np.uint64(56)).astype(np.uint8).tobytes()


def _once(sig: np.ndarray, cls: np.ndarray, flag: np.ndarray | None = None):
    """Distinct (signature, class) pairs in order; where a signature begins; whether it is held by several
    classes or flagged."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
    if flag is not None:
        flag = np.logical_or.reduceat(flag[order], np.flatnonzero(new))
    sig, cls = sig[new], cls[new]
    head = np.r_[True, sig[1:] != sig[:-1]]
    group = np.cumsum(head) - 1
    many = np.bincount(group) > 1
    if flag is not None:
        many |= np.bincount(group, flag) > 0
    return sig, cls, head, many[group]


def _sketch_task(rule: Rule, buckets: int):
    """Packed for the buckets: documents ("D"), repeated signatures of the task ("R"), other signatures ("E")."""

    def packed(sig: list[np.ndarray], cls: list[int], turn: int) -> Iterator[pa.RecordBatch]:
        names = np.repeat(np.array(cls, np.int64), [len(s) for s in sig])
        values, names, head, many = _once(np.concatenate(sig), names)
        again = many & ~head
        for at in range(0, int(again.sum()), 65536):
            part = np.flatnonzero(again)[at:at + 65536]
            yield _row((turn + at // 65536) % buckets, b"R" + values[part].tobytes() + names[part].tobytes())
        values, names, many = values[head], names[head], many[head]
        home = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            p = order[edges[b]:edges[b + 1]]
            blob = values[p].tobytes() + names[p].tobytes() + many[p].astype(np.uint8).tobytes()
            yield _row(b, b"E" + zstandard.ZstdCompressor(level=1).compress(blob))  # names repeat

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sig, cls, waiting, turn = WordHashes(), [], [], 0, 0
        for part in batches:
            names, sizes, bands = [], [], []
            for text in utf8(part.column(1)):
                grams = shingles(text, rule, hashes)
                name = class_of(grams)
                names.append(name)
                sizes.append(len(grams))
                bands.append((0, 0, 0))
                if name is not None:
                    found, needs = signatures_and_needs(grams, rule)
                    bands[-1] = (band_of(len(grams), rule), *needs)
                    sig.append(found)
                    cls.append(name)
                    waiting += len(sig[-1])
                    if waiting >= FLUSH:
                        yield from packed(sig, cls, turn)
                        sig, cls, waiting = [], [], 0
            ids = part.column(0).to_pylist()
            turn = (xxhash.xxh32_intdigest(str(ids[:8])) + turn) % buckets if ids else turn
            yield _row(turn, b"D" + _docs(ids, sizes, names, bands))
        if waiting:
            yield from packed(sig, cls, turn)

    return task


def _row(bucket: int, blob: bytes) -> pa.RecordBatch:
    return batch(PACKED, {"bucket": [bucket], "blob": [blob]})


def _docs(ids: list[int | None], sizes: list[int], names: list[int | None], bands: list[tuple[int, int, int]]) -> bytes:
    return b"".join(np.array(x, np.int64).tobytes() for x in (
        [i if i is not None else 0 for i in ids], [i is not None for i in ids], sizes,
        [n if n is not None else 0 for n in names], [n is not None for n in names], *([b[k] for b in bands] for k in range(3))))


def _bucket_task(table: pa.Table) -> pa.Table:
    """One bucket: its documents, and the entries of signatures that several classes hold."""
    sig, cls, flag = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    ready_sig, ready_cls, docs = [], [], [np.zeros((8, 0), np.int64)]
    for blob in table.column("blob").to_pylist():
        kind, blob = blob[:1], memoryview(blob)[1:]
        if kind == b"E":
            blob = zstandard.ZstdDecompressor().decompress(blob)
            count = len(blob) // 17
            sig.append(np.frombuffer(blob, np.uint64, count))
            cls.append(np.frombuffer(blob, np.int64, count, 8 * count))
            flag.append(np.frombuffer(blob, np.uint8, count, 16 * count))
        elif kind == b"R":
            count = len(blob) // 16
            ready_sig.append(np.frombuffer(blob, np.int64, count))
            ready_cls.append(np.frombuffer(blob, np.int64, count, 8 * count))
        else:
            docs.append(np.frombuffer(blob, np.int64).reshape(8, -1))
    flags = np.concatenate(flag) > 0
    if len(flags):
        values, names, _, many = _once(np.concatenate(sig), np.concatenate(cls), flags)
        ready_sig.append(values[many].view(np.int64))
        ready_cls.append(names[many])
    ids, known, sizes, names, named, *bands = np.concatenate(docs, axis=1)
    held = pa.table({"sig": np.concatenate([np.zeros(0, np.int64), *ready_sig]),
                     "cls": np.concatenate([np.zeros(0, np.int64), *ready_cls])})
    for name in BUCKETED.names[2:]:
        held = held.append_column(name, pa.nulls(len(held), pa.int64()))
    rows = pa.table([pa.nulls(len(ids), pa.int64()), pa.array(names, mask=named == 0), pa.array(ids, mask=known == 0), sizes, *bands], schema=BUCKETED)
    return pa.concat_tables([held, rows])


def sketch(docs: DataFrame, rule: Rule, path: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, cls, band, own, above)`` of every document, written to ``path``, and ``(sig, cls)`` of the signatures
    held by several classes, from one pass over the texts. ``own`` and ``above`` are what ``signatures_and_needs`` says."""
    members_path = new_path(docs.sparkSession, "ngram-members")
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text // TEXT_PER_BUCKET)
    made = map_batches(docs, _sketch_task(rule, buckets), "bucket int, blob binary")
    with run_folder(docs.sparkSession):
        layout = ", ".join(f"{name} bigint" for name in BUCKETED.names)
        rows = stage(made.groupBy("bucket").applyInArrow(_bucket_task, layout), "ngram-sketch")
        documents = stage(rows.where("sig is null").drop("sig"), "ngram-documents", path)
        members = stage(rows.where("sig is not null").select("sig", "cls").distinct(), "ngram-members", members_path)
    return documents, members


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def wanted_filter(wanted: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS hashed values: however many there are, its size stays the same."""
    numbered = wanted.select((_place(column) + 1).alias("p"))  # the bitmap functions count from 1
    rows = (numbered.select(F.bitmap_bucket_number("p").alias("b"), F.bitmap_bit_position("p").alias("i"))
            .groupBy("b").agg(F.bitmap_construct_agg("i").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for row in rows:
        at = (row["b"] - 1) * len(row["bits"])
        out[at:at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def prefiltered(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose value in ``column`` is in ``wanted``, and a few more: dropped by a bitmap of two megabytes where
    they are read, so that an exact join after it moves little."""
    bits = rows.sparkSession.sparkContext.broadcast(wanted_filter(wanted, column))
    last = len(rows.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            place = part.column(last).to_numpy(zero_copy_only=False)
            known = (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield part.filter(pa.array(known.astype(bool))).select(list(range(last)))

    return map_batches(rows.withColumn("_place", _place(column)), task, rows.schema)


def sets_of(docs: DataFrame, chosen: DataFrame, rule: Rule) -> DataFrame:
    """Sets and sketches of the classes of the chosen documents, one row per class as far as a document has one text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in batches:
            found = [(t, g) for t, g in ((t, shingles(t, rule, hashes)) for t in utf8(part.column(1))) if len(g)]
            grams = [g for _, g in found]
            bands = [band_of(len(g), rule) for g in grams]
            if grams:
                yield batch(SETS, {
                    "cls": [class_of(g) for g in grams], "n": [len(g) for g in grams], "band": bands,
                    "own": [block_bytes(g, b, rule) for g, b in zip(grams, bands)],
                    "above": [block_bytes(g, b + 1, rule) for g, b in zip(grams, bands)], "words": [packed_words(t) for t, _ in found]})

    near = prefiltered(docs, chosen, "doc_id")
    exact = near.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return map_batches(exact, task, "cls bigint, n int, band int, own binary, above binary, words binary")


def overlap_reaches(a: np.ndarray, b: np.ndarray, needed: int) -> bool:
    """Whether two sorted rows share ``needed`` columns; block after block, given up as soon as they cannot."""
    if min(len(a), len(b)) < needed:
        return False
    ends_a, ends_b = [*np.searchsorted(a, CUTS), len(a)], [*np.searchsorted(b, CUTS), len(b)]
    shared = at_a = at_b = 0
    for end_a, end_b in zip(ends_a, ends_b):
        x, y = a[at_a:end_a], b[at_b:end_b]
        if len(x) and len(y):
            place = np.searchsorted(y, x)
            place[place == len(y)] = 0
            shared += int(np.count_nonzero(y[place] == x))
        at_a, at_b = end_a, end_b
        if shared + min(len(a) - at_a, len(b) - at_b) < needed:
            return False
    return shared >= needed


CUTS = np.array([i << 61 for i in range(1, COLUMN_BLOCKS)], np.uint64)


def linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The ``(a, b)`` pairs of classes that link: those whose sketches in ``band`` allow it, multiplied exactly."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b, *sides = part.columns
            keep = [_sketches_allow(rule, *row) for row in zip(*(c.to_pylist() for c in sides))]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = Unpacked(rule)
        for part in batches:
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                a, b = unpacked.of(x, 0), unpacked.of(y, 1)
                keep.append(overlap_reaches(a, b, rule.needed(len(a), len(b))))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def with_sides(rows: DataFrame, table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
        for side in ("a", "b"):
            rows = rows.join(table.select(F.col("cls").alias(side), *keys, *[F.col(c).alias(f"{c}_{side}") for c in names]), [side, *keys])
        return rows.select("a", "b", *[f"{c}_{side}" for side in ("a", "b") for c in names])

    left = stage(map_batches(with_sides(pairs, sketches, ["band"], ["n", "sketch"]), near, "a bigint, b bigint").distinct(), "ngram-near")
    wanted = left.select(F.explode(F.array("a", "b")).alias("cls"))
    held = prefiltered(sets.select("cls", "words"), wanted, "cls")
    return map_batches(with_sides(left, held, [], ["words"]), exact, "a bigint, b bigint").distinct()


def _sketches_allow(rule: Rule, n_a: int, x: bytes, n_b: int, y: bytes) -> bool:
    if 100 * min(n_a, n_b) < rule.percent * max(n_a, n_b):
        return False
    return int(np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))) <= rule.difference(n_a + n_b)


def _banded(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with the band that a signature was made in, and the signatures that a link of the row takes there."""
    parity = F.abs(F.pmod("sig", F.lit(2)) - F.pmod("band", F.lit(2)))  # the last bit of a signature tells the bands apart
    return members.join(classes.select("cls", "band", "own", "above"), "cls").select(
        "sig", "cls", (F.col("band") + parity).cast("int").alias("band"), F.when(parity == 0, F.col("own")).otherwise(F.col("above")).alias("need"))


def _able(members: DataFrame, group: str, size: int = 0) -> DataFrame:
    """The members of signatures that span several values of ``group`` and have more than ``size`` members, of rows that
    hold as many of those as a link takes. All others link with nobody of another ``group``: their signatures were shared by chance,
    or with a passage, and would tie rows together in families that grow with the square of the table."""
    spans = members.groupBy("sig").agg(F.min(group).alias("x"), F.max(group).alias("y"), F.count("*").alias("size")).where(
        (F.col("x") != F.col("y")) & (F.col("size") > size)).select("sig")
    rows = members.join(spans, "sig")
    enough = rows.groupBy("cls", "band").agg(F.count("*").alias("held"), F.max("need").alias("need")).where("held >= need")
    return rows.join(enough.select("cls", "band"), ["cls", "band"])


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of groups that span several components, with their component. A group of two was one pair, which the hub
    round has decided."""
    now = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return _able(stage(_able(now, "root", 2), "ngram-open"), "root")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Every member with the hub of its group, the member whose name hashes highest: mostly the same one in the
    groups of a family."""
    hubs = members.groupBy("sig").agg(F.max(F.struct(F.xxhash64("cls").alias("spin"), "cls")).alias("hub")).select(
        "sig", F.col("hub.cls").alias("b"))
    both = members.join(hubs, "sig").where("cls <> b")
    return both.groupBy(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).agg(F.min("band").alias("band"))


def _families(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of all families, dealt to blocks: home, family, low, high, part, cls, band. ``sizes`` has ``cls, n``."""
    # a row is a node of its own in each band
    nodes = stage(members.withColumn("node", F.xxhash64("cls", "band")), "ngram-nodes")
    first = nodes.groupBy("sig").agg(F.min("node").alias("b"))
    families = components(nodes.join(first, "sig").select(F.col("node").alias("a"), "b").distinct()).select(
        F.col("cls").alias("node"), F.col("root").alias("family"))
    rows = stage(nodes.select("node", "cls", "band").distinct().join(families, "node").join(sizes, "cls"), "ngram-family-rows")
    whole = rows.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("size") / FAMILY_ROWS), F.ceil(F.col("grams") / FAMILY_GRAMS)).cast("int")
    homes = max(1, (rows.agg(F.sum("n")).first()[0] or 0) // FAMILY_GRAMS)
    rows = rows.join(whole.select("family", parts.alias("parts")), "family").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    home = F.when(F.col("parts") == 1, F.pmod("family", F.lit(homes))).otherwise(F.xxhash64("family", "low", "high"))
    return rows.withColumn("home", home).select("home", "family", "low", "high", "part", "cls", "band")


def product_links(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, root: np.ndarray, rule: Rule) -> np.ndarray:
    """Which rows of ``left`` link with which of ``right`` (indices into ``grams``), across components; a matrix of flags.

    The overlaps are the product of the two incidence matrices, formed over blocks of columns.
    """
    size = np.array([len(g) for g in grams])
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    values, row = every[order], np.repeat(np.arange(len(grams)), size)[order]
    column = np.cumsum(np.r_[False, values[1:] != values[:-1]])
    shared_by = np.bincount(column)
    several = shared_by[column] > 1
    column, row = np.cumsum(shared_by > 1)[column[several]] - 1, row[several]

    small, large = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    needed = -(-rule.percent * (small + large) // (100 + rule.percent))
    open_pairs = (root[left][:, None] != root[right][None, :]) & (100 * small >= rule.percent * large)
    overlap = np.zeros(open_pairs.shape, np.int32)
    rest = np.bincount(row, minlength=len(grams))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for start, stop in zip(edges[:-1], edges[1:]):
        open_pairs &= overlap + np.minimum.outer(rest[left], rest[right]) >= needed
        at_left, at_right = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
        if not len(at_left):
            break
        block = np.zeros((len(grams), int(column[stop - 1] - column[start]) + 1), np.float32)
        block[row[start:stop], column[start:stop] - column[start]] = 1
        overlap[np.ix_(at_left, at_right)] += (block[left[at_left]] @ block[right[at_right]].T).astype(np.int32)
        rest -= np.bincount(row[start:stop], minlength=len(grams))
    return open_pairs & (overlap >= needed)


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows, at most one per component but one, that span the components which the links connect."""
    names, component = np.unique(root, return_inverse=True)
    meet = np.zeros((len(names), len(names)), bool)
    x, y = np.nonzero(links)
    meet[component[left[x]], component[right[y]]] = True
    meet |= meet.T
    label = np.arange(len(names))
    while True:
        least = np.minimum(label, np.where(meet, label[None, :], len(names)).min(axis=1, initial=len(names)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    first = np.full(len(names), -1)
    first[component[::-1]] = np.arange(len(root))[::-1]
    return [(int(first[i]), int(first[j])) for i, j in enumerate(label) if i != j]


def _blocks(table: pa.Table) -> Iterator[tuple]:
    """The blocks of a home that span several components: their rows, which of them are left and right, and the components."""
    table = table.sort_by([("family", "ascending"), ("low", "ascending"), ("high", "ascending"), ("cls", "ascending")])
    key = np.stack([table.column(c).to_numpy() for c in ("family", "low", "high", "cls")])
    new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]  # a class can have come in several copies of a row
    table, key = table.filter(pa.array(new)), key[:, new]
    edges = np.r_[0, np.flatnonzero((key[:3, 1:] != key[:3, :-1]).any(axis=0)) + 1, key.shape[1]]
    root, part = (table.column(c).to_numpy() for c in ("root", "part"))
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        r = root[start:stop]
        if (r != r[0]).any():
            left, right = (np.flatnonzero(part[start:stop] == key[side, start]) for side in (1, 2))
            if len(left) and len(right):
                yield table.slice(start, stop - start), left, right, r


def _candidate_task(rule: Rule):
    """The rows of a home that have a partner in another component of their block as far as sketches can tell."""

    def task(table: pa.Table) -> pa.Table:
        out = [table.slice(0, 0)]
        for rows, left, right, root in _blocks(table):
            n = rows.column("n").to_numpy().astype(np.int64)
            bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
            keep = np.zeros(len(n), bool)
            for i in left:
                at = right[(root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= rule.percent * np.maximum(n[right], n[i]))]
                near = at[np.count_nonzero(bits[at] != bits[i], axis=1) <= (n[at] + n[i]) * (100 - rule.percent) // (100 + rule.percent)]
                keep[near] = True
                keep[i] |= len(near) > 0
            out.append(rows.filter(pa.array(keep)))
        return pa.concat_tables(out).select(["home", "family", "low", "high", "part", "cls", "root"])

    return task


def _product_task(rule: Rule):
    """The spanning links of all blocks of a home."""

    def task(table: pa.Table) -> pa.Table:
        pairs, unpacked = [], Unpacked(rule)
        for rows, left, right, root in _blocks(table):
            cls = rows.column("cls").to_numpy()
            grams = [unpacked.of(w.as_py()) for w in rows.column("words")]
            pairs += [(cls[i], cls[j]) for i, j in spanning(product_links(grams, left, right, root, rule), left, right, root)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return task


PLACED = "home bigint, family bigint, low int, high int, part int, cls bigint, root bigint"


def _family_links(families: DataFrame, roots: DataFrame, sketches: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b)``: links that span the components of each block of a family.

    Sketches leave out the rows that link with nobody in their block, so that few sets travel."""
    rows = families.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = rows.join(sketches, ["cls", "band"]).select("home", "family", "low", "high", "part", "cls", "root", "n", "sketch")
    left = stage(rows.groupBy("home").applyInArrow(_candidate_task(rule), PLACED), "ngram-candidates")
    held = left.join(sets.select("cls", "words"), "cls").select("home", "family", "low", "high", "part", "cls", "root", "words")
    return held.groupBy("home").applyInArrow(_product_task(rule), "a bigint, b bigint")


def class_components(docs: DataFrame, members: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``(cls, root)`` of the classes that link with another; ``docs`` has ``doc_id, text``."""
    spark = docs.sparkSession
    path = new_path(spark, "ngram-roots")
    with run_folder(spark):
        members = stage(_banded(members, classes), "ngram-banded")
        members = stage(_able(members, "cls"), "ngram-able")
        named = F.coalesce("doc_id", F.lit(NOBODY)).alias("doc_id")  # rows without id can be chosen too
        docs = docs.select(named, "text")
        chosen = members.select("cls").distinct().join(classes, "cls").select(named).distinct()
        sets = stage(sets_of(docs, chosen, rule), "ngram-sets")
        both_bands = F.array(F.struct("band", F.col("own").alias("sketch")), F.struct((F.col("band") + 1).alias("band"), F.col("above").alias("sketch")))
        sketches = stage(sets.select("cls", "n", F.inline(both_bands)).dropDuplicates(["cls", "band"]), "ngram-sketches")
        links = stage(linked(_hub_pairs(members), sketches, sets, rule), "ngram-links")
        roots = components(links)
        families = stage(_families(_open(members, roots), classes.select("cls", "n")), "ngram-families")
        found = _family_links(families, roots, sketches, sets, rule)
        return stage(components(stage(links.unionByName(found), "ngram-links")), "ngram-roots", path)


def link_documents(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``.

    ``component_id`` is the smallest id that links lead to, the document's own included; ``class_id`` names its set
    of n-grams (null when it is empty), so equal sets share it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    kept = [new_path(spark, name) for name in ("ngram-documents", "ngram-shared")]
    with tidy(spark), run_folder(spark):
        rows, members = sketch(docs, rule, kept[0])
        classes = stage(rows.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n", "band", "own", "above")]), "ngram-classes")
        roots = class_components(docs, members, classes, rule)
        joined = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        # only classes with copies or links can differ from their own document
        shared = stage(joined.join(smallest, "root").where(
            (F.col("copies") > 1) | ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("cls", "component_id", "copies"), "ngram-shared", kept[1])
    return lookup(rows.select("doc_id", "n", "cls"), shared, "cls", "copies", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("cls").alias("class_id"))


def keep_one(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the smallest id, of each component. Documents without words or id stay.

    Rows that share an id stay or go together; they go only if each of them belongs to a smaller id.
    """
    spark = docs.sparkSession
    path = new_path(spark, "ngram-dropped")
    with tidy(spark), run_folder(spark):
        found = link_documents(docs, rule, id_col, text_col)
        go = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("component_id") < F.col("doc_id")).alias("go"))
        drop = stage(go.where("go").select(F.col("doc_id").alias("_drop")), "ngram-dropped", path)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key = F.col(names[docs.columns.index(id_col)]).cast("long")
    return docs.toDF(*names).join(drop, key == F.col("_drop"), "left_anti").toDF(*docs.columns)
