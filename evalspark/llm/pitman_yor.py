"""Language-model scoring with a hierarchical Pitman-Yor model.

A text is its words and one end mark. Every word is served in the restaurant of its left neighbour; each left
neighbour seen in training has one of its own. The parent of a neighbour's restaurant is the restaurant of all words
with the same ending (``ENDINGS`` classes); words at the beginning of a text are served in a restaurant of the middle
level. Those share the root, and the root's base is uniform over all known words and one unknown. Customers of a
table are customers of the parent restaurant, so contexts share strength.

*Seating.* Gibbs sweeps draw the number of tables of every dish in every restaurant anew, given the table
totals and the parents' probabilities of the sweep before. Up to ``EXACT`` customers the draw is from the
exact conditional (generalised Stirling numbers); beyond, customers are seated in growing groups. Discounts
are estimated from the numbers of dishes with one and two customers; strengths are 1. Probabilities are
averaged over the sweeps after ``BURN_IN``.

*On Spark.* All statistics cover all training documents. Words are 64-bit hashes; left neighbours are told apart by
48 bits of it and their ending. The ``FREQUENT`` most frequent words are set apart only to keep work even: pairs of
two of them stay with their documents and are counted in a table of bounded size. All other tokens are packed and
dealt to buckets, once: by word, or by left neighbour if the word is a frequent one. A bucket holds all customers of
its words, in every context. In each sweep a bucket sends the tables of its left neighbours' restaurants to their
owners (groups by hash of the neighbour), which add them up and answer each bucket; totals of the frequent
neighbours, the middle level and the root are bounded and pass through the driver. A bucket draws with a seed of its
own and repeats its earlier sweeps from the totals and answers, so that a lost task gives the same result again. No
remaining word or neighbour holds more than ``1 / FREQUENT`` of the tokens, whatever the table.

Edge cases: null text is empty and has the end mark alone; documents with null id are learned from;
repeated rows are scored once each and learned from as often as they occur; without training documents
every probability is 1; an empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, utf8, words_of
from evalspark.session import new_path, stage, tidy

FREQUENT = 512
ENDINGS = 1024
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
EXACT = 24
SEED = 7
BUCKET_TOKENS = 1_000_000  # tokens per bucket, frequent words included
PARTIAL_ROWS = 1_000_000  # partial sums of documents that a task gathers before it passes them on
FLUSH = 800_000  # tokens for buckets that a task gathers before it packs them
TOGETHER = 4  # buckets that a task reads
OWNED = 16  # buckets per owner of neighbours' totals

END = b" end"  # no word holds a space
CODES = FREQUENT + ENDINGS + 1  # contexts: frequent words, endings, the beginning
BEGIN = CODES - 1
RESTAURANTS = ENDINGS + 1  # of the middle level
LEARNED = 1 << 15  # bit of a context code: the token is one to learn from
WIDTH = 2 * FREQUENT + 2 * RESTAURANTS + 2 + 6  # of the totals
CELLS = FREQUENT * RESTAURANTS  # frequent words in the middle restaurants


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Vocabulary(dict):
    """Numbers of the words met in a task, with their hash, their place among the frequent and their context code."""

    LIMIT = 250_000

    def __init__(self, frequent: list[int]):
        super().__init__()
        self.frequent = {h: i for i, h in enumerate(frequent)}
        self.hash, self.place, self.code = (np.zeros(1 << 16, t) for t in (np.uint64, np.int32, np.uint16))

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.hash):
            self.hash, self.place, self.code = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.place, self.code))
        value = word_hash(word)
        place = self.frequent.get(value, -1)
        self.hash[number], self.place[number] = value, place
        self.code[number] = place if place >= 0 else FREQUENT + ending(word)
        self[word] = number
        return number

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each with its end mark, and the tokens per text."""
        if len(self) > self.LIMIT:
            self.clear()
        words: list[bytes] = []
        sizes = []
        for text in texts:
            mine = words_of(text)
            words += mine
            words.append(END)
            sizes.append(len(mine) + 1)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), np.array(sizes, np.int64)


def ending(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n, ending)`` over the training documents; words as hashes, counted in the tasks first."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("ending", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Vocabulary([]), np.zeros(0, np.int64)

        def found() -> Iterator[pa.RecordBatch]:
            hashes, endings = known.hash[:len(counts)].view(np.int64), known.code[:len(counts)].astype(np.int32) - FREQUENT
            for at in range(0, len(counts), 65536):
                cut = slice(at, at + 65536)
                yield batch(schema, {"word": hashes[cut], "n": counts[cut], "ending": endings[cut]})

        for part in batches:
            if len(known) > known.LIMIT:
                yield from found()
                counts = np.zeros(0, np.int64)
            numbers, _ = known.numbers(utf8(part.column(0)))
            more = np.bincount(numbers, minlength=len(known))
            more[:len(counts)] += counts
            counts = more
        yield from found()

    rows = map_batches(docs.where(~held_out()).select("text"), task, "word bigint, n bigint, ending int")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.max("ending").alias("ending"))


PACKED = pa.schema([("bucket", pa.int32()), ("flush_row", pa.int64()), ("first_row", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                    ("n_tokens", pa.list_(pa.int64())), ("n_frequent", pa.list_(pa.int32())), ("blob", pa.binary())])
PACKED_SQL = ("bucket int, flush_row bigint, first_row bigint, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, "
              "n_frequent array<int>, blob binary")
FRAGMENT = (np.uint64, np.uint32, np.uint16, np.uint16, np.uint64, np.uint64, np.uint32, np.uint16, np.uint16)
SEATS = (np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint16, np.uint32)
ROWS = (np.uint32, np.uint32, np.uint16, np.uint32, np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _stretch(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte, so that small numbers take little."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    return _squeeze(sizes, *(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T for a in arrays))


def _unpack(blob: bytes, types: tuple) -> list[np.ndarray]:
    data = _stretch(blob)
    at, out = 8 * len(types), []
    for kind, size in zip(map(np.dtype, types), np.frombuffer(data, np.int64, len(types)).tolist()):
        raw = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(raw.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def _rows(part: pa.RecordBatch) -> Iterator[dict]:
    """Rows with large blobs, one copied at a time."""
    for at in range(part.num_rows):
        yield part.slice(at, 1).to_pylist()[0]


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(ordered)])


def _share(key: np.ndarray, shares: int) -> np.ndarray:
    """The share that a hash falls into; ascends with the hash."""
    return ((key >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)


def packed_tokens(docs: DataFrame, frequent: list[int], buckets: int) -> DataFrame:
    """One row per batch of documents with their pairs of frequent words (``bucket`` below 0), and rows of
    packed tokens for the buckets. A flush is a run of documents, named by its first row, whose tokens for
    buckets were packed together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(frequent)
        waiting: list[tuple[np.ndarray, ...]] = []
        base = count = 0
        for part in batches:
            if not part.num_rows:
                continue
            rows = part.column(0).to_numpy()
            if waiting and (count >= FLUSH or rows[-1] - base >= 1 << 16):
                yield from packed(waiting, base)
                waiting, count = [], 0
            base = rows[0] if not waiting else base
            held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            numbers, sizes = known.numbers(utf8(part.column(3)))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            code = np.empty(len(numbers), np.uint16)
            code[1:] = known.code[numbers[:-1]]
            code[np.cumsum(sizes) - sizes] = BEGIN
            behind = (code >= FREQUENT) & (code < BEGIN)  # a neighbour that is not frequent
            learned = np.where(held[owner], 0, LEARNED).astype(np.uint16)
            place = known.place[numbers]
            rare = place < 0
            often = ~rare & ~behind
            yield batch(PACKED, {
                "bucket": [-1 - int(rows[0] % 8191) % buckets], "flush_row": [base], "first_row": rows[:1], "doc_id": [part.column(1).to_pylist()],
                "held_out": [held.tolist()], "n_tokens": [sizes.tolist()], "n_frequent": [np.bincount(owner[often], minlength=len(sizes)).tolist()],
                "blob": [_squeeze(place[often].astype(np.uint16), code[often] | learned[often])]})
            doc = (rows[0] - base + owner).astype(np.uint16)
            neighbour = np.zeros(len(numbers), np.uint64)
            neighbour[1:] = known.hash[numbers[:-1]] >> np.uint64(16)
            aside = ~rare & behind
            waiting.append((known.hash[numbers[rare]], code[rare] | learned[rare], doc[rare], neighbour[rare],
                            neighbour[aside] << np.uint64(16) | code[aside], place[aside].astype(np.uint16) | learned[aside], doc[aside]))
            count += len(numbers) - int(often.sum())
        if waiting:
            yield from packed(waiting, base)

    def packed(waiting: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        word, code, doc, neighbour, key, place, doc2 = (np.concatenate(x) for x in zip(*waiting))
        order, order2 = np.argsort(word), np.argsort(key)
        word, code, doc, neighbour = word[order], code[order], doc[order], neighbour[order]
        key, place, doc2 = key[order2], place[order2], doc2[order2]
        edges, edges2 = (np.searchsorted(_share(x, buckets), np.arange(buckets + 1, dtype=np.uint64)) for x in (word, key))
        for b in np.flatnonzero((edges[1:] > edges[:-1]) | (edges2[1:] > edges2[:-1])).tolist():
            cut, cut2 = slice(edges[b], edges[b + 1]), slice(edges2[b], edges2[b + 1])
            heads, heads2 = _heads(word[cut]), _heads(key[cut2])
            place_code = code[cut] & (LEARNED - 1)
            blob = _pack(_steps(word[cut][heads]), np.diff(np.r_[heads, len(word[cut])]).astype(np.uint32), code[cut], doc[cut],
                         neighbour[cut][(place_code >= FREQUENT) & (place_code < BEGIN)],
                         _steps(key[cut2][heads2]), np.diff(np.r_[heads2, len(key[cut2])]).astype(np.uint32), place[cut2], doc2[cut2])
            yield batch(PACKED, {"bucket": [b], "flush_row": [base], "first_row": [base], "doc_id": [None], "held_out": [None], "n_tokens": [None],
                                 "n_frequent": [None], "blob": [blob]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    return map_batches(rows, task, PACKED_SQL)


MERGED_SQL = PACKED_SQL + ", seats binary, rows binary"


def _merge(table: pa.Table, parents: np.ndarray) -> pa.Table:
    """All tokens of one bucket as pairs of word and context, by word and middle restaurant; batches of documents
    as they are."""
    none = pa.nulls(table.num_rows, pa.binary())
    if table.column("bucket")[0].as_py() < 0:
        return table.append_column("seats", none).append_column("rows", none)
    found = [_unpack(blob, FRAGMENT) for blob in table.column("blob").to_pylist()]
    word = np.concatenate([np.repeat(np.cumsum(f[0], dtype=np.uint64), f[1]) for f in found])
    code, doc, neighbour = (np.concatenate([f[i] for f in found]) for i in (2, 3, 4))
    part = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f[2]) for f in found])
    key = np.concatenate([np.repeat(np.cumsum(f[5], dtype=np.uint64), f[6]) for f in found])
    place, doc2 = (np.concatenate([f[i] for f in found]) for i in (7, 8))
    part2 = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f[7]) for f in found])
    del found

    context = (code & (LEARNED - 1)).astype(np.int64)
    room = np.concatenate([parents, np.arange(RESTAURANTS)])[context]
    behind = np.flatnonzero((context >= FREQUENT) & (context < BEGIN))
    keys, number = np.unique(np.concatenate([neighbour << np.uint64(16) | context[behind].astype(np.uint64), key]), return_inverse=True)
    context[behind] = CODES + number[:len(behind)]
    width = CODES + len(keys)
    words, kind = np.unique(word, return_inverse=True)
    del word, neighbour, key

    def pairs(pair: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(pair)
        pair = pair[order]
        heads = _heads(pair)
        counts = np.add.reduceat((learned[order] >= LEARNED).astype(np.uint32), heads) if len(heads) else np.zeros(0)
        return order, pair[heads], np.diff(np.r_[heads, len(pair)]).astype(np.uint32), counts.astype(np.uint32)

    order, pair, runs, counts = pairs((kind * RESTAURANTS + room) * width + context, code)
    order2, pair2, runs2, counts2 = pairs(number[len(behind):] * FREQUENT + (place & (LEARNED - 1)), place)
    seats = _pack(np.bincount(pair // (width * RESTAURANTS), minlength=len(words)).astype(np.uint32), (pair % width).astype(np.uint32), counts, _steps(keys),
                  _steps((pair2 // FREQUENT).astype(np.uint32)), (pair2 % FREQUENT).astype(np.uint16), counts2)
    rows = _pack(runs, runs2, np.concatenate([doc[order], doc2[order2]]), np.concatenate([part[order], part2[order2]]),
                 table.column("first_row").to_numpy().astype(np.int64))
    one = table.slice(0, 1).set_column(table.column_names.index("blob"), "blob", pa.nulls(1, pa.binary()))
    return one.append_column("seats", pa.array([seats], pa.binary())).append_column("rows", pa.array([rows], pa.binary()))


class Bucket:
    """The tokens of a bucket as pairs: of a word with every context, and of a frequent word with left
    neighbours that are not frequent (``*2``). ``keys`` are the bucket's neighbours that are not frequent."""

    def __init__(self, blob: bytes, number: int, parents: np.ndarray):
        runs, code, count, keys, neighbour, place, count2 = _unpack(blob, SEATS)
        self.number, self.keys = number, np.cumsum(keys, dtype=np.uint64)
        ends = (self.keys & np.uint64(LEARNED - 1)).astype(np.int64) - FREQUENT
        self.seats = Seats(np.repeat(np.arange(len(runs)), runs), code.astype(np.int64), count.astype(np.int64), len(runs))
        self.seats.place(parents, ends)
        self.neighbour, self.place, self.count2 = np.cumsum(neighbour, dtype=np.int64), place.astype(np.int64), count2.astype(np.int64)
        self.cell = self.place * RESTAURANTS + ends[self.neighbour]
        self.t2 = np.minimum(self.count2, 1)

    def guests(self, mine: np.ndarray, aside: np.ndarray) -> np.ndarray:
        """Sums per neighbour of what the pairs have."""
        own = np.flatnonzero(self.seats.code >= CODES)
        out = np.bincount(self.seats.code[own] - CODES, mine[own], len(self.keys))
        return (out + np.bincount(self.neighbour, aside, len(self.keys))).astype(np.uint32)

    def sweep(self, turn: int, world: World, told: Told) -> None:
        totals, rng = world.totals[turn].own(told.customers, told.tables[turn]), np.random.default_rng([SEED, self.number, turn])
        self.seats.sweep(totals, rng)
        some = np.flatnonzero(self.count2 > 0)
        weight = (STRENGTH + totals.discount[2] * told.tables[turn][self.neighbour[some]]) * world.middle[turn][self.cell[some]]
        self.t2[some] = draw_tables(self.count2[some], weight, totals.discount[2], rng)

    def probabilities(self, turn: int, world: World, told: Told) -> tuple[np.ndarray, np.ndarray]:
        totals = world.totals[turn].own(told.customers, told.tables[turn])
        aside = _served(self.count2, self.t2, told.customers[self.neighbour], told.tables[turn][self.neighbour], totals.discount[2],
                        world.middle[turn][self.cell].astype(np.float64))
        return self.seats.probabilities(totals)[2], aside

    def averaged(self, world: World, told: Told) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all pairs, averaged over the sweeps after the burn-in."""
        out, out2 = np.zeros(len(self.seats.count)), np.zeros(len(self.count2))
        for turn in range(SWEEPS):
            self.sweep(turn, world, told)
            if turn >= BURN_IN:
                p, p2 = self.probabilities(turn + 1, world, told)
                out += p
                out2 += p2
        return out / (SWEEPS - BURN_IN), out2 / (SWEEPS - BURN_IN)

    def sums(self) -> np.ndarray:
        """Totals, then the tables that neighbours send into the middle restaurants of frequent words."""
        out = self.seats.sums()
        out[-2:] += (self.count2 == 1).sum(), (self.count2 == 2).sum()
        return np.concatenate([out, np.bincount(self.cell, self.t2, CELLS)])


class World:
    """What all buckets share, turn by turn: totals, and the probabilities of frequent words in the middle."""

    def __init__(self, parents: np.ndarray):
        self.parents = parents
        self.totals: list[Totals] = []
        self.middle: list[np.ndarray] = []


class Told:
    """The owners' answers to a bucket: customers and, turn by turn, tables of its neighbours' restaurants."""

    def __init__(self, replies: list[dict] | None):
        turns: dict[int, list[bytes]] = {}
        for reply in sorted(replies or [], key=lambda r: (r["turn"], r["owner"])):
            turns.setdefault(reply["turn"], []).append(reply["blob"])
        found = [_unpack(blob, (np.uint32, np.uint32)) for blob in turns.get(0, [])]
        none = [np.zeros(0, np.uint32)]
        self.customers = np.concatenate([f[0] for f in found] + none).astype(np.int64)
        self.tables = [np.concatenate([f[1] for f in found] + none).astype(np.int64)]
        for turn in range(1, SWEEPS + 1):
            later = [_unpack(blob, (np.uint32,))[0] for blob in turns.get(turn, [])]
            self.tables.append(np.concatenate(later + none).astype(np.int64))


@functools.lru_cache(maxsize=64)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers up to EXACT customers: [customers, tables]."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        for t in range(1, c + 2):
            stay = out[c, t] + math.log(c - discount * t) if t <= c and c > discount * t else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts given customers and the weight of opening a table (parent's probability times strength)."""
    tables = np.minimum(customers, 1)
    logs = stirling(discount)
    some = np.flatnonzero((customers >= 2) & (customers <= EXACT))
    if len(some):
        many, x = customers[some], np.log(np.maximum(weight[some], 1e-300))
        pick = rng.random(len(some))
        order = np.argsort(many, kind="stable")
        edges = np.searchsorted(many[order], np.arange(EXACT + 2))
        for c in range(2, EXACT + 1):
            mine = order[edges[c]:edges[c + 1]]
            if len(mine):
                p = logs[c, 1:c + 1] + x[mine, None] * np.arange(1, c + 1)
                p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
                tables[some[mine]] = 1 + (p < (pick[mine] * p[:, -1])[:, None]).sum(axis=1)
    left = np.flatnonzero(customers > EXACT)
    if len(left):
        goal, x = customers[left], weight[left]
        seated, opened = np.ones(len(left)), np.ones(len(left))
        live = np.arange(len(left))
        while len(live):
            group = np.minimum(np.maximum(1, seated[live] // 8), goal[live] - seated[live])
            opens = x[live] / (x[live] + seated[live] - discount * opened[live])
            opened[live] += rng.binomial(group.astype(np.int64), np.clip(opens, 0, 1))
            seated[live] += group
            live = live[seated[live] < goal[live]]
        tables[left] = opened
    return tables


class Totals:
    """Customers and tables of all restaurants, and what discounts are estimated from."""

    def __init__(self, values: np.ndarray, parents: np.ndarray, known: int):
        cuts = np.cumsum([FREQUENT, FREQUENT, RESTAURANTS, RESTAURANTS, 1, 1])
        self.c2, self.t2, self.c1, self.t1, (self.c0,), (self.t0,), seen = np.split(values, cuts)
        self.discount = [min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5 for one, two in seen.reshape(3, 2)]
        self.parents, self.known = parents, known

    def own(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """With the restaurants of neighbours that are not frequent behind those of the frequent ones."""
        out = copy.copy(self)
        out.c2, out.t2 = np.concatenate([self.c2, customers]), np.concatenate([self.t2, tables])
        return out


class Seats:
    """The customers of some words: pairs of word and context with counts, and their tables on three levels.

    Contexts from ``CODES`` on are neighbours that are not frequent, numbered from there.
    """

    def __init__(self, word: np.ndarray, code: np.ndarray, count: np.ndarray, words: int):
        self.word, self.code, self.count, self.words = word, code, count, words
        self.total = np.bincount(word, count, words).astype(np.int64)
        self.top = (code < FREQUENT) | (code >= CODES)
        self.room = np.where(code >= CODES, code - CODES + FREQUENT, code)
        self.aside: np.ndarray | int = 0  # customers that others send into the middle restaurants

    def place(self, parents: np.ndarray, others: np.ndarray | None = None) -> None:
        """Pairs of word and middle restaurant; ``parents`` gives the ending of each frequent word, ``others`` of
        the neighbours that are not frequent."""
        above = np.concatenate([parents, np.arange(RESTAURANTS), *([] if others is None else [others])])  # by code
        key = self.word.astype(np.int64) * RESTAURANTS + above[self.code]
        if (key[1:] >= key[:-1]).all():
            heads = _heads(key)
            self.key1, self.above = key[heads], np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(key)]))
        else:
            self.key1, self.above = np.unique(key, return_inverse=True)
        self.word1, self.room1 = self.key1 // RESTAURANTS, self.key1 % RESTAURANTS
        self.direct = np.bincount(self.above, np.where(self.top, 0, self.count), len(self.key1)).astype(np.int64)
        self.t2 = np.where(self.top, np.minimum(self.count, 1), 0)
        self.start()

    def start(self) -> None:
        """One table per dish."""
        self._raise(lambda c: np.minimum(c, 1), lambda c: np.minimum(c, 1))

    def _raise(self, middle, root) -> None:
        self.c1 = self.direct + self.aside + np.bincount(self.above, self.t2, len(self.key1)).astype(np.int64)
        self.t1 = middle(self.c1)
        self.c0 = np.bincount(self.word1, self.t1, self.words).astype(np.int64)
        self.t0 = root(self.c0)

    def sweep(self, totals: Totals, rng: np.random.Generator) -> None:
        """Seat everybody anew, given the totals of the sweep before."""
        p0, p1, _ = self.probabilities(totals)
        d0, d1, d2 = totals.discount
        top = np.flatnonzero(self.top & (self.count > 0))
        weight = (STRENGTH + d2 * totals.t2[self.room[top]]) * p1[self.above[top]]
        self.t2[top] = draw_tables(self.count[top], weight, d2, rng)
        self._raise(lambda c: draw_tables(c, (STRENGTH + d1 * totals.t1[self.room1]) * p0[self.word1], d1, rng),
                    lambda c: draw_tables(c, np.full(len(c), (STRENGTH + d0 * totals.t0) / (totals.known + 1)), d0, rng))

    def probabilities(self, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities at the root per word, in the middle per pair there, and per pair."""
        d0, d1, d2 = totals.discount
        p0 = _served(self.c0, self.t0, totals.c0, totals.t0, d0, 1 / (totals.known + 1))
        p1 = _served(self.c1, self.t1, totals.c1[self.room1], totals.t1[self.room1], d1, p0[self.word1])
        p = p1[self.above]
        top = np.flatnonzero(self.top)
        room = self.room[top]
        p[top] = _served(self.count[top], self.t2[top], totals.c2[room], totals.t2[room], d2, p[top])
        return p0, p1, p

    def sums(self) -> np.ndarray:
        top, near = self.top, self.code < FREQUENT
        ones = [x for c in (self.c0, self.c1, self.count[top]) for x in ((c == 1).sum(), (c == 2).sum())]
        return np.concatenate([
            np.bincount(self.code[near], self.count[near], FREQUENT), np.bincount(self.code[near], self.t2[near], FREQUENT),
            np.bincount(self.room1, self.c1, RESTAURANTS), np.bincount(self.room1, self.t1, RESTAURANTS),
            [self.c0.sum(), self.t0.sum()], ones]).astype(np.float64)


def _served(c, t, all_c, all_t, discount, parent):
    """Pitman-Yor prediction; an empty restaurant passes on its parent's."""
    return (np.maximum(c - discount * t, 0) + (STRENGTH + discount * all_t) * parent) / (STRENGTH + all_c)


REPLIES_SQL = "array<struct<turn: int, owner: int, blob: binary>>"
LETTER = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("blob", pa.binary()), ("sums", pa.binary())])
LETTER_SQL = "owner int, bucket int, keys binary, blob binary, sums binary"
REPLY_SQL = "owner int, bucket int, blob binary"


def _buckets(table: DataFrame, replies: list[DataFrame], tasks: int, *columns: str) -> DataFrame:
    """The buckets with all answers to them; the table is written by bucket, so only answers travel."""
    mine = table.where("bucket >= 0").select("bucket", *columns)
    if not replies:
        return mine.withColumn("replies", F.lit(None).cast(REPLIES_SQL))
    told = replies[0]
    for more in replies[1:]:
        told = told.unionByName(more)
    told = told.repartition(tasks, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("turn", "owner", "blob")).alias("replies"))
    return mine.join(told, "bucket", "left").select("bucket", *columns, "replies")


def _letters(buckets: DataFrame, turn: int, world: World, owners: int) -> DataFrame:
    """After ``turn`` sweeps: tables per neighbour for the owners (``keys``, and customers, in the first turn
    only), and one row of totals per task."""
    shared = buckets.sparkSession.sparkContext.broadcast(world)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(WIDTH + CELLS)
        for part in batches:
            for row in _rows(part):
                bucket, told = Bucket(row["seats"], row["bucket"], shared.value.parents), Told(row["replies"])
                for earlier in range(turn):
                    bucket.sweep(earlier, shared.value, told)
                out += bucket.sums()
                tables = bucket.guests(bucket.seats.t2, bucket.t2)
                customers = None if turn else bucket.guests(bucket.seats.count, bucket.count2)
                edges = np.searchsorted(_share(bucket.keys, owners), np.arange(owners + 1, dtype=np.uint64))
                for owner in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                    cut = slice(edges[owner], edges[owner + 1])
                    yield batch(LETTER, {"owner": [owner], "bucket": [bucket.number], "keys": [None if turn else _pack(_steps(bucket.keys[cut]))],
                                         "blob": [_pack(tables[cut]) if turn else _pack(customers[cut], tables[cut])], "sums": [None]})
        yield batch(LETTER, {"owner": [-1], "bucket": [None], "keys": [None], "blob": [None], "sums": [_pack(out)]})

    return map_batches(buckets, task, LETTER_SQL)


def _answers(letters: DataFrame, first: DataFrame, turn: int) -> DataFrame:
    """Every owner adds up what the buckets say of a neighbour and tells each bucket the sums."""
    types = (np.uint32,) if turn else (np.uint32, np.uint32)

    def answer(table: pa.Table) -> pa.Table:
        keys: dict[int, np.ndarray] = {}
        values: dict[int, list[np.ndarray]] = {}
        for row in table.to_pylist():
            if row["keys"] is not None:
                keys[row["bucket"]] = np.cumsum(_unpack(row["keys"], (np.uint64,))[0], dtype=np.uint64)
            if row["blob"] is not None:
                values[row["bucket"]] = _unpack(row["blob"], types)
        known, number = np.unique(np.concatenate(list(keys.values())), return_inverse=True)
        sums = [np.bincount(number, np.concatenate([values[b][i] for b in keys]), len(known)).astype(np.uint32)[number] for i in range(len(types))]
        edges = np.cumsum([0, *map(len, keys.values())])
        blobs = [_pack(*(x[low:high] for x in sums)) for low, high in zip(edges[:-1], edges[1:])]
        return pa.table({"owner": pa.array([table.column("owner")[0].as_py()] * len(keys), pa.int32()), "bucket": pa.array(list(keys), pa.int32()),
                         "blob": pa.array(blobs, pa.binary())})

    rows = letters.where("owner >= 0").select("owner", "bucket", "keys", "blob")
    if turn:
        rows = rows.unionByName(first.where("owner >= 0").select("owner", "bucket", "keys", F.lit(None).cast("binary").alias("blob")))
    return rows.groupBy("owner").applyInArrow(answer, REPLY_SQL).withColumn("turn", F.lit(turn))


def _sums_of(letters: DataFrame) -> np.ndarray:
    """Totals over all buckets."""
    schema = pa.schema([("slot", pa.int32()), ("value", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(WIDTH + CELLS)
        for part in batches:
            for blob in part.column(0).to_pylist():
                out += _unpack(blob, (np.float64,))[0]
        slots = np.flatnonzero(out)
        yield batch(schema, {"slot": slots.astype(np.int32), "value": out[slots]})

    rows = map_batches(letters.where("owner = -1").select("sums"), task, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    found = rows.toArrow()  # at most WIDTH + CELLS rows
    out = np.zeros(WIDTH + CELLS)
    out[found.column("slot").to_numpy()] = found.column("value").to_numpy()
    return out


def _frequent_counts(tokens: DataFrame) -> np.ndarray:
    """Training tokens per (frequent word, context); summed in the tasks, of bounded size."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FREQUENT * CODES, np.int64)
        for part in batches:
            for blob in part.column(0).to_pylist():
                place, code = np.frombuffer(_stretch(blob), np.uint16).reshape(2, -1)
                learned = code >= LEARNED
                out += np.bincount(place[learned].astype(np.int64) * CODES + (code[learned] & (LEARNED - 1)), minlength=len(out))
        cells = np.flatnonzero(out)
        yield batch(schema, {"cell": cells.astype(np.int32), "n": out[cells]})

    rows = map_batches(tokens.where("bucket < 0").select("blob"), task, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most FREQUENT * CODES rows
    out = np.zeros(FREQUENT * CODES, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


PARTIAL = pa.schema([("flush_row", pa.int64()), ("first_row", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                     ("n_tokens", pa.list_(pa.int64())), ("blob", pa.binary())])
PARTIAL_SQL = "flush_row bigint, first_row bigint, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, blob binary"
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _sums(place: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> bytes:
    """Sums of some documents of a flush, by their place in it."""
    return b"".join(x.tobytes() for x in (base.astype(np.float64), score.astype(np.float64), known.astype(np.uint32), place.astype(np.uint16)))


def _bucket_scores(buckets: DataFrame, world: World, base2: np.ndarray, all_tokens: int) -> DataFrame:
    """Sums over the tokens of the buckets, a row per task and flush."""
    shared = buckets.sparkSession.sparkContext.broadcast((world, base2))

    def merged(waiting: list[tuple[np.ndarray, ...]], flushes: set[int]) -> Iterator[pa.RecordBatch]:
        row, *values = (np.concatenate(x) for x in zip(*waiting))
        rows, place = np.unique(row, return_inverse=True)
        sums = [np.bincount(place, x, len(rows)) for x in values]
        first = np.array(sorted(flushes))
        edges = np.r_[np.searchsorted(rows, first), len(rows)]
        for at, low, high in zip(first.tolist(), edges[:-1], edges[1:]):
            if high > low:
                yield batch(PARTIAL, {"flush_row": [at], "first_row": [at], "doc_id": [None], "held_out": [None], "n_tokens": [None],
                                      "blob": [_sums(rows[low:high] - at, *(x[low:high] for x in sums))]})

    def scored(bucket: Bucket, replies: list[dict] | None, row: np.ndarray, runs: np.ndarray, runs2: np.ndarray) -> tuple[np.ndarray, ...]:
        every, often = shared.value
        seats = bucket.seats
        score, score2 = bucket.averaged(every, Told(replies))
        base = np.log10((seats.total + 1.0) / (all_tokens + every.totals[0].known + 1))[seats.word]
        known = (seats.total > 0)[seats.word].astype(np.int64)
        rows, place = np.unique(row, return_inverse=True)
        each = ((known, np.ones(len(score2), np.int64)), (base, often[bucket.place]), (np.log10(score), np.log10(score2)))
        return rows, *[np.bincount(place, np.concatenate([np.repeat(x, runs), np.repeat(y, runs2)]), len(rows)) for x, y in each]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        flushes: set[int] = set()
        for part in batches:
            for found in _rows(part):
                runs, runs2, doc, flush, first = _unpack(found["rows"], ROWS)
                flushes.update(first.tolist())
                bucket = Bucket(found["seats"], found["bucket"], shared.value[0].parents)
                waiting.append(scored(bucket, found["replies"], first[flush] + doc, runs, runs2))
                if sum(len(w[0]) for w in waiting) >= PARTIAL_ROWS:
                    yield from merged(waiting, flushes)
                    waiting, flushes = [], set()
        if waiting:
            yield from merged(waiting, flushes)

    return map_batches(buckets, task, PARTIAL_SQL)


def _frequent_scores(tokens: DataFrame, score: np.ndarray, base: np.ndarray) -> DataFrame:
    """Sums over the pairs of frequent words, a row per batch of documents."""
    shared = tokens.sparkSession.sparkContext.broadcast((score, base))  # FREQUENT * CODES numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bases = shared.value
        for part in batches:
            for row in part.to_pylist():
                place, code = np.frombuffer(_stretch(row["blob"]), np.uint16).reshape(2, -1)
                count = np.array(row["n_frequent"])
                docs = np.arange(len(count))
                owner = np.repeat(docs, count)
                cell = place.astype(np.int64) * CODES + (code & (LEARNED - 1))
                sums = _sums(row["first_row"] - row["flush_row"] + docs, count, np.bincount(owner, bases[place], len(count)),
                             np.bincount(owner, scores[cell], len(count)))
                yield batch(PARTIAL, {**{k: [row[k]] for k in PARTIAL.names if k != "blob"}, "blob": [sums]})

    return map_batches(tokens.where("bucket < 0").drop("bucket", "seats", "rows"), task, PARTIAL_SQL)


def _scores_of_flush(table: pa.Table) -> pa.Table:
    """The documents of a flush with all their sums."""
    rows = table.to_pylist()
    size = 1 + max(r["first_row"] - r["flush_row"] + len(r["n_tokens"]) for r in rows if r["n_tokens"] is not None)
    known, base, score = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
    out: dict[str, list] = {"doc_id": [], "held_out": [], "n_tokens": []}
    at: list[int] = []
    for row in rows:
        count = len(row["blob"]) // 22
        place = np.frombuffer(row["blob"], np.uint16, count, 20 * count)
        base[place] += np.frombuffer(row["blob"], np.float64, count)
        score[place] += np.frombuffer(row["blob"], np.float64, count, 8 * count)
        known[place] += np.frombuffer(row["blob"], np.uint32, count, 16 * count)
        if row["n_tokens"] is not None:
            for name, values in out.items():
                values += row[name]
            at += range(row["first_row"] - row["flush_row"], row["first_row"] - row["flush_row"] + len(row["n_tokens"]))
    found = {**out, "n_known": known[at], "base_score": base[at], "score": score[at]}
    return pa.table([pa.array(found[f.name], f.type) for f in SCORED], schema=SCORED)


def _by_bucket(rows: DataFrame, tasks: int) -> DataFrame:
    """Written once, in files by bucket, so that a join by bucket does not move it again."""
    spark = rows.sparkSession
    path = new_path(spark, "token-buckets")
    name = f"token_buckets_{path.rpartition('-')[2]}"
    rows.write.bucketBy(tasks, "bucket").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return table


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every document.

    ``score`` is the log10 probability of the text, ``base_score`` that of an add-one unigram model.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stage(word_counts(docs), "word-counts")
    size = counts.agg(F.count("*").alias("known"), F.sum("n").alias("tokens")).first()
    known, all_tokens = size["known"], size["tokens"] or 0
    often = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = [r["word"] % (1 << 64) for r in often]
    parents = np.zeros(FREQUENT, np.int64)
    parents[:len(often)] = [r["ending"] for r in often]

    buckets = max(8, -(-all_tokens // BUCKET_TOKENS))
    tasks, owners = max(8, buckets // TOGETHER), max(8, buckets // OWNED)
    with tidy(docs.sparkSession):
        packed = packed_tokens(docs, frequent, buckets).repartition(tasks, "bucket").groupBy("bucket")
        tokens = _by_bucket(packed.applyInArrow(lambda table: _merge(table, parents), MERGED_SQL), tasks)
        cells = _frequent_counts(tokens)
        hot = Seats(np.repeat(np.arange(FREQUENT), CODES), np.tile(np.arange(CODES), FREQUENT), cells, FREQUENT)
        hot.place(parents)
        world, replies = World(parents), []
        average = np.zeros(len(cells))
        for turn in range(SWEEPS + 1):
            letters = stage(_letters(_buckets(tokens, replies, tasks, "seats"), turn, world, owners), "letters")
            first = letters if turn == 0 else first
            sums = _sums_of(letters)
            hot.aside = sums[WIDTH:].astype(np.int64)
            if turn:
                hot.sweep(world.totals[turn - 1], np.random.default_rng([SEED, buckets, turn]))
            else:
                hot.start()
            world.totals.append(Totals(hot.sums() + sums[:WIDTH], parents, known))
            _, middle, p = hot.probabilities(world.totals[turn])
            world.middle.append(middle.astype(np.float32))
            if turn > BURN_IN:
                average += p / (SWEEPS - BURN_IN)
            replies.append(stage(_answers(letters, first, turn), "answers"))
    base = np.zeros(FREQUENT)
    base[:len(often)] = [math.log10((r["n"] + 1.0) / (all_tokens + known + 1)) for r in often]

    scored = _bucket_scores(_buckets(tokens, replies, tasks, "seats", "rows"), world, base, all_tokens)
    parts = scored.unionByName(_frequent_scores(tokens, np.log10(average), base))
    whole = parts.groupBy("flush_row").applyInArrow(_scores_of_flush, SCORED_SQL)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score",
                        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
