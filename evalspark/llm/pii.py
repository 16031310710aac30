"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: strict patterns with their checks (the *base*
spans, which always stay) and loose ones - addresses written with "at" and "dot", numbers without a
country code, cards with other separators, colon-separated addresses. Boosted trees judge every candidate
by its format (lengths of its groups, separators, checksums) and by its context (words
in front, characters around it). They learn from all strict matches of all documents but every third, by
hash, which is held out. The strict patterns and their
checks say there what is personal and what merely looks like it; every base span is also written in
loose forms, right ones (the same data in another notation) and wrong ones (a digit changed, a date or a
version in its place), which the loose generators must tell apart in the same context. A threshold per
kind, calibrated on all candidates that were not learned from, selects the loose candidates that are added; a kind
without enough evidence adds none. Of overlapping spans, base ones win, then the surest.

*On Spark.* Examples are counted by their features, then by the bins of their features; borders of the bins are quantiles of all
examples. Every level of a tree is a scan of these counts that adds up a histogram. Up to ``LOCAL_ROWS`` distinct rows
of bins the same scans run on the driver. No example is left out, but numerous ones weigh less: the matches of one
document, kind and outcome weigh ``DOC_WEIGHT`` together at most, and all of a kind and outcome ``KIND_WEIGHT``. Thresholds are found
from plain numbers of examples. Sums are of whole numbers, so the order of the rows plays no part.

Offsets are code points, ends exclusive. The scan of a text takes time in proportion to its length.

Edge cases: null text is empty and has no span; empty tables give empty results; repeated rows are judged
once each; other columns are carried through redaction untouched.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.ordered import running_totals
from evalspark.llm.common import batch, map_batches, strings
from evalspark.session import stage

KINDS = ("email", "ip", "card", "phone")
KIND_WEIGHT = 2000  # of all matches to learn from, per kind and outcome of the check
DOC_WEIGHT = 8  # of those in one document
UNIT = 1 << 30  # whole numbers of weights, gradients and curvatures
DOC_UNIT = 1 << 20  # whole numbers of weights in a document
LOCAL_ROWS = 50_000  # distinct rows of bins that are scanned on the driver
CHUNK = 4096  # rows of a batch that a task passes on
SPAN = 512  # characters of a match that are kept to learn from; no loose form is longer
MIN_EVIDENCE = 20  # examples of either side without which a kind adds nothing
PRECISION = 0.99  # of the added spans, on candidates held out of learning
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs of digits: a run is read once, whatever follows.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Loose forms, each within bounded length.
SPOKEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
AT = re.compile(r"(?=\[at\]|\(at\)|\{at\}| at )", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{2,6}(?:[./_ -]{1,3}[0-9]{2,6}){2,5}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?![0-9])")
LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_IP4 = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[.,\[\]()]{1,3} ?[0-9]{1,3}){3}(?![0-9])")
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "master", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"),
}
NUMBERS_OF_OTHER_KINDS = ("version", "isbn", "page", "section", "chapter", "no.", "id", "date", "year")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, from @ to @: no character is read twice."""
    free = 0  # where the next match may begin
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def strict_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, passes its check`` of every match of the strict patterns, in reading order of each kind."""
    out = [("email", start, end, True) for start, end in _emails(text)]
    for m in IP.finditer(text):
        out.append(("ip", m.start(), m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))))
    for m in CARD.finditer(text):
        size = m.end() - m.start()
        digits = _digits(m[0]) if size < 64 else ""
        out.append(("card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15))
    return out


def _spoken(text: str) -> Iterator[tuple[int, int]]:
    """The matches of SPOKEN, looked for around the at-marks alone."""
    free = 0  # where the next match may begin
    for mark in AT.finditer(text):
        at = mark.start()
        if at < free:
            continue
        found = SPOKEN.search(text, max(free, at - 65), at + 512)
        if found and found.start() <= at:
            yield found.span()
            free = found.end()


def loose_matches(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the loose generators; they may overlap each other and the strict ones."""
    out = []
    out += [("email", *place) for place in _spoken(text)]
    if DIGIT.search(text):
        for kind, pattern in (("card", LOOSE_CARD), ("phone", LOOSE_PHONE), ("ip", LOOSE_IP4)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if ":" in text:
        out += [("ip", m.start(), m.end()) for m in LOOSE_IP.finditer(text)]
    return out


DIGIT = re.compile("[0-9]")


def _rough(value: int) -> int:
    """The ten leading bits of a number, so that features have few values."""
    low = max(0, value.bit_length() - 10)
    return value >> low << low


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:min(end, start + 128)]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before, after = text[max(0, start - 32):start].lower(), text[end:end + 1]
    left = text[start - 1:start]
    parts = [int(g) for g in re.findall("[0-9]{1,6}", span)] or [0]
    marks = [c for c in span if not c.isalnum()]
    return [
        KINDS.index(kind), _rough(end - start), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        len(marks), len(set(marks)), float(span[:1] == "+"), float("(" in span), float("." in span), float("-" in span),
        float(" " in span), float(":" in span), float("@" in span or "at" in span.lower()), float(luhn(digits) if len(digits) >= 8 else 0),
        _rough(max(parts)), sum(c.isalpha() for c in span), float(left.isalnum()), float(after.isalnum()),
        float(left in ".,-/$#€£%"), float(digits[:1] == "0"), float(digits[:1] in ("3", "4", "5", "6")),
        float(any(w in before for w in CONTEXT[kind])), float(any(w in before for w in NUMBERS_OF_OTHER_KINDS)),
        float(len(set(digits))),
    ]


class BoostedTrees:
    """Gradient boosting of small trees on the logistic loss: per tree the features, cuts and values of a complete tree in level order.

    A row goes to the right when its feature is above the cut; nodes without a split have an infinite one. Cuts are on the bins of
    the features while trees are grown, on the features themselves in the end.
    """

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.cut, self.value = start, feature, cut, value

    def with_tree(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> BoostedTrees:
        return BoostedTrees(self.start, np.vstack([self.feature, feature]), np.vstack([self.cut, cut]), np.vstack([self.value, value]))

    def on_values(self, borders: list[np.ndarray]) -> BoostedTrees:
        """The trees with cuts on values; values up to the n-th border lie in the bins up to the n-th."""
        cut = np.array([[borders[f][int(c)] if np.isfinite(c) else np.inf for f, c in zip(*tree)] for tree in zip(self.feature, self.cut)])
        return BoostedTrees(self.start, self.feature, cut.reshape(self.cut.shape), self.value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in range(len(self.value)):
            score += self.value[tree][_leaf(x, self.feature[tree], self.cut[tree], DEPTH)]
        return 1 / (1 + np.exp(-score))


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of every row in a level of a tree, counted from the left."""
    rows, place = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(depth):
        node = (1 << level) - 1 + place
        place = 2 * place + (x[rows, feature[node]] > cut[node])
    return place


def histogram(counts: tuple[np.ndarray, ...], trees: BoostedTrees, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Gradients, curvatures and numbers of examples per node of a level, feature and bin; weighted sums are whole numbers of 1 / UNIT."""
    bins, good, bad, good_weight, bad_weight = counts
    p = trees.probability(bins)
    weights = np.rint(good_weight * (1 - p) - bad_weight * p), np.rint((good_weight + bad_weight) * (p * (1 - p))), (good + bad).astype(float)
    node = _leaf(bins, feature, cut, depth)
    out = np.empty((1 << depth, bins.shape[1], BINS, 3))
    for f in range(bins.shape[1]):
        for k, weight in enumerate(weights):
            out[:, f, :, k] = np.bincount(node * BINS + bins[:, f], weight, BINS << depth).reshape(-1, BINS)
    return out


def grown(start: float, borders: list[np.ndarray], scan: Callable[[BoostedTrees, np.ndarray, np.ndarray, int], np.ndarray]) -> BoostedTrees:
    """Trees on bins; ``scan`` gives the histogram of a level."""
    inner = (1 << DEPTH) - 1
    trees = BoostedTrees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    useless = np.arange(BINS - 1) >= np.array([len(b) for b in borders])[:, None]
    for _ in range(TREES):
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            sums = scan(trees, feature, cut, depth)
            sums[..., :2] /= UNIT
            total = sums[:, :1].sum(axis=2, keepdims=True)
            left = np.cumsum(sums, axis=2)[:, :, :-1]
            gain = _worth(left) + _worth(total - left) - _worth(total)
            gain[:, useless] = -np.inf
            best = gain.reshape(len(gain), -1)
            sides = np.stack([total[:, 0, 0], np.zeros_like(total[:, 0, 0])], axis=1)
            for node, at in enumerate(best.argmax(axis=1)):
                if total[node, 0, 0, 2] >= 10 and best[node, at] > 1e-6:
                    f, c = divmod(int(at), BINS - 1)
                    feature[(1 << depth) - 1 + node], cut[(1 << depth) - 1 + node] = f, c
                    sides[node] = left[node, f, c], total[node, 0, 0] - left[node, f, c]
        sides = sides.reshape(-1, 3)
        trees = trees.with_tree(feature, cut, RATE * sides[:, 0] / (sides[:, 1] + 1.0))
    return trees


def _worth(sums: np.ndarray) -> np.ndarray:
    return sums[..., 0] ** 2 / (sums[..., 1] + 1)


class Selector:
    """The trees and the threshold of each kind."""

    def __init__(self, trees: BoostedTrees | None = None, threshold: dict[str, float] | None = None):
        self.trees, self.threshold = trees, threshold or {}

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Loose candidates that are sure enough and overlap nothing surer."""
        if not self.threshold:
            return []
        taken = _Covered(base)
        loose = [c for c in loose_matches(text) if c[0] in self.threshold and taken.apart(c)]
        if not loose:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in loose]))
        out, added = [], _Covered([])
        for i in sorted(range(len(loose)), key=lambda i: (-p[i], loose[i][1], -loose[i][2], KINDS.index(loose[i][0]))):
            if p[i] >= self.threshold[loose[i][0]] and added.apart(loose[i]):
                out.append(loose[i])
                added.put(loose[i])
        return out


def _rewritten(kind: str, value: str, turn: int) -> list[tuple[str, bool]]:
    """Loose notations of a base span, and look-alikes that are not personal data."""
    digits = _digits(value)
    if kind == "email":
        name, _, domain = value.partition("@")
        spelled = domain.replace(".", (" dot ", " [dot] ", ".")[turn % 3])
        return [(f"{name} [at] {spelled}", True), (f"{name}(at){domain}", True), (f"{name} at {spelled}", True),
                (f"{('look', 'see', 'meet', 'stay')[turn % 4]} at {domain}", False), (f"look at {domain.split('.')[0]} dot {turn % 90 + 10}", False)]
    if kind == "ip":
        parts = value.split(".")
        return [("[.]".join(parts), True), (f"{turn % 28 + 1}.{turn % 12 + 1}.{2000 + turn % 30}, {turn % 24}", False),
                (",".join(str(int(p) + 300)[:3] for p in parts), False)]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + turn % 8) % 10)
        dotted = [".".join(d[i:i + 4] for i in range(0, len(d), 4)) for d in (digits, wrong)]
        return [(dotted[0], True), (dotted[1], False), (dotted[1].replace(".", "/"), False)]
    tail = digits[-10:]
    return [(f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", True), (f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", True), (f"00{digits[:-10] or 1} {tail[:3]} {tail[3:6]} {tail[6:]}", True),
            (f"{1900 + turn % 140}-{turn % 12 + 1:02}-{turn % 28 + 1:02}", False), (f"{turn % 90 + 10}/{turn % 30 + 10}/{turn % 50 + 1970}", False),
            (f"{turn % 900 + 100}-{turn % 900 + 100}", False), (f"{turn % 40 + 10}.{turn % 70 + 10}.{turn % 97}", False)]


def drawn(doc_id: int | None, text: str) -> Iterator[tuple]:
    """``kind, fine, weight, key, before, span, size, after, turn`` of the strict matches of a document."""
    found = strict_matches(text)
    many = Counter((kind, fine) for kind, _, _, fine in found)
    for kind, start, end, fine in found:
        key = xxhash.xxh3_64_intdigest(f"{doc_id} {start} {kind}") >> 1
        weight = max(1, DOC_UNIT * DOC_WEIGHT // max(DOC_WEIGHT, many[kind, fine]))
        yield kind, fine, weight, key, text[max(0, start - 40):start], text[start:min(end, start + SPAN)], end - start, text[end:end + 8], start


def examples(kind: str, fine: bool, before: str, span: str, size: int, after: str, turn: int) -> Iterator[tuple[list[float], bool]]:
    """A strict match with the outcome of its check; one that passes also in other notations."""
    x = features(before + span + after, kind, len(before), len(before) + len(span))
    x[1] = _rough(size)
    yield x, fine
    if not fine or size > SPAN:
        return
    for value, right in _rewritten(kind, span, turn):
        changed = before + value + after
        whole = [c for c in loose_matches(changed)
                 if c[0] == kind and c[1] <= len(before) + 1 and c[2] >= len(before) + len(value) - 1]
        for _, low, high in whole[:1]:
            yield features(changed, kind, low, high), right


class _Covered:
    """The stretches of a text that spans cover, in order, so that one look-up answers for all of them."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def apart(self, span: tuple[str, int, int]) -> bool:
        before = bisect.bisect_left(self.starts, span[2])
        return not before or self.ends[before - 1] <= span[1]

    def put(self, span: tuple[str, int, int]) -> None:
        """Add a span that is apart from all others."""
        at = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict matches that pass their check, by start and then kind."""
    spans = [(kind, start, end) for kind, start, end, fine in strict_matches(text) if fine]
    return _ordered(spans)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


DRAWN = pa.schema([("kind", pa.string()), ("fine", pa.bool_()), ("weight", pa.int64()), ("key", pa.int64()), ("before", pa.string()),
                   ("span", pa.string()), ("size", pa.int64()), ("after", pa.string()), ("turn", pa.int64())])
DRAWN_SQL = "kind string, fine boolean, weight bigint, key bigint, before string, span string, size bigint, after string, turn bigint"
COUNTS = ("good", "bad", "good_weight", "bad_weight")  # numbers of right and wrong examples, and their weights
COUNTS_SQL = ", ".join(f"{c} bigint" for c in COUNTS)


def training_matches(docs: DataFrame) -> DataFrame:
    """All strict matches; those of repeated rows count once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            matches = (m for doc_id, text in zip(part.column(0).to_pylist(), strings(part.column(1))) for m in drawn(doc_id, text))
            while chunk := list(itertools.islice(matches, CHUNK)):
                yield batch(DRAWN, dict(zip(DRAWN.names, zip(*chunk))))

    return map_batches(docs.select("doc_id", "text"), task, DRAWN_SQL).distinct()


def example_counts(matches: DataFrame) -> DataFrame:
    """Numbers and weights of the examples with the same features (``x``, single precision)."""
    keys = [("kind", pa.string()), ("fine", pa.bool_()), ("strict", pa.bool_()), ("held", pa.bool_()), ("x", pa.binary())]
    schema = pa.schema([*keys, *[(c, pa.int64()) for c in COUNTS]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            counts: dict[tuple, np.ndarray] = {}
            for kind, fine, weight, key, *window in zip(*(c.to_pylist() for c in part.columns)):
                for number, (values, right) in enumerate(examples(kind, fine, *window)):
                    cell = kind, fine, not number, key % 3 == 0, np.array(values, np.float32).tobytes()
                    counts[cell] = counts.get(cell, 0) + np.array([right, not right, weight * right, weight * (not right)], np.int64)
            if counts:
                columns = [*zip(*counts), *np.array(list(counts.values())).T]
                yield batch(schema, dict(zip(schema.names, columns)))

    rows = map_batches(matches.select(*DRAWN.names), task, f"kind string, fine boolean, strict boolean, held boolean, x binary, {COUNTS_SQL}")
    return _summed(rows, *[k for k, _ in keys])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def _weighed(part: pa.RecordBatch, scale: dict[tuple[str, bool], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, numbers and weights of the rows of ``example_counts``, weights as whole numbers of 1 / UNIT."""
    x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(part.num_rows, -1)
    good, bad, *weights = (part.column(c).to_numpy() for c in COUNTS)
    each = np.array([scale[group] for group in zip(part.column("kind").to_pylist(), part.column("fine").to_pylist())])
    return x, np.column_stack([good, bad]), np.column_stack([np.rint(w * each * (UNIT // DOC_UNIT)) for w in weights]).astype(np.int64)


def _borders(vectors: DataFrame, scale: dict[tuple[str, bool], float], width: int) -> list[np.ndarray]:
    """Weighted quantiles of every feature over the examples to learn from."""
    schema = pa.schema([("feature", pa.int32()), ("value", pa.float64()), ("weight", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x, _, weights = _weighed(part, scale)
                for f, column in enumerate(x.T):
                    values, place = np.unique(column, return_inverse=True)
                    sums = np.zeros(len(values), np.int64)
                    np.add.at(sums, place, weights.sum(axis=1))
                    yield batch(schema, {"feature": np.full(len(values), f, np.int32), "value": values.astype(float), "weight": sums})

    rows = map_batches(vectors.where("not held"), task, "feature int, value double, weight bigint", CHUNK)
    found = rows.groupBy("feature", "value").agg(F.sum("weight").alias("weight")).orderBy("feature", "value").toArrow()  # rough values: few
    feature, value, weight = (found.column(c).to_numpy() for c in schema.names)
    out = []
    for f in range(width):
        mine = feature == f
        total = np.cumsum(weight[mine])
        at = np.searchsorted(total, np.linspace(0, 1, BINS + 1)[1:-1] * (total[-1] if len(total) else 0))
        out.append(np.unique(value[mine][at]) if len(total) else np.zeros(0))
    return out


def _binned(vectors: DataFrame, scale: dict[tuple[str, bool], float], borders: list[np.ndarray]) -> DataFrame:
    """Numbers and weights of the examples with the same kind and bins."""
    schema = pa.schema([("kind", pa.string()), ("held", pa.bool_()), ("bins", pa.binary()), *[(c, pa.int64()) for c in COUNTS]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x, numbers, weights = _weighed(part, scale)
                bins = np.column_stack([np.searchsorted(b, column, "left") for b, column in zip(borders, x.T)]).astype(np.uint8)
                yield batch(schema, {"kind": part.column("kind"), "held": part.column("held"), "bins": [row.tobytes() for row in bins],
                                     **dict(zip(COUNTS, [*numbers.T, *weights.T]))})

    return _summed(map_batches(vectors, task, f"kind string, held boolean, bins binary, {COUNTS_SQL}", CHUNK), "kind", "held", "bins")


def _counts(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(part.num_rows, -1)
    return bins.astype(np.int64), *(part.column(c).to_numpy() for c in COUNTS)


def _scan(rows: DataFrame, shape: tuple[int, int]) -> Callable[[BoostedTrees, np.ndarray, np.ndarray, int], np.ndarray]:
    """Histograms over a table of counts: a partial one per task, added up on the driver."""
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def scan(trees: BoostedTrees, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((1 << depth, *shape, 3))
            for part in batches:
                if part.num_rows:
                    out += histogram(_counts(part), trees, feature, cut, depth)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        parts = map_batches(rows, task, "part binary", CHUNK).toArrow().column("part").to_pylist()
        return sum((np.frombuffer(part).reshape(-1, *shape, 3) for part in parts), np.zeros((1 << depth, *shape, 3)))

    return scan


def _probabilities(rows: DataFrame, trees: BoostedTrees) -> DataFrame:
    """``kind, p, good, bad`` of the held-out examples, one row per kind and probability."""
    schema = pa.schema([("kind", pa.string()), ("p", pa.float64()), ("good", pa.int64()), ("bad", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                bins, good, bad, *_ = _counts(part)
                yield batch(schema, {"kind": part.column("kind"), "p": trees.probability(bins), "good": good, "bad": bad})

    found = map_batches(rows, task, "kind string, p double, good bigint, bad bigint", CHUNK)
    return found.groupBy("kind", "p").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def thresholds(rows: DataFrame, trees: BoostedTrees) -> dict[str, float]:
    """Per kind the smallest probability from one half on at which enough of the held-out examples are right."""
    ordered = running_totals(_probabilities(rows, trees), ["kind"], "p", {"good": "good_below", "bad": "bad_below"}, overall={"good": "all_good", "bad": "all_bad"})
    right, wrong = F.col("all_good") - F.col("good_below"), F.col("all_bad") - F.col("bad_below")
    evidence = (F.col("all_good") >= MIN_EVIDENCE) & (F.col("all_bad") >= MIN_EVIDENCE)  # else nothing to tell right from wrong by
    sure = ordered.where(evidence & (F.col("p") >= 0.5)).withColumn("sure", wrong <= (1 - PRECISION) * (wrong + right))
    found = sure.groupBy("kind").agg(F.min_by("sure", "p").alias("at_half"), F.min(F.when(F.col("sure") & (F.col("good") > 0), F.col("p"))).alias("cut"))
    return {r["kind"]: 0.5 if r["at_half"] else r["cut"] for r in found.collect() if r["at_half"] or r["cut"] is not None}


def learn(docs: DataFrame) -> Selector:
    vectors = stage(example_counts(training_matches(docs)), "pii-examples")
    weighed = vectors.where("strict").groupBy("kind", "fine").agg(F.sum(F.col("good_weight") + F.col("bad_weight")).alias("weight")).collect()
    scale = {(r["kind"], r["fine"]): min(1.0, KIND_WEIGHT * DOC_UNIT / r["weight"]) for r in weighed}
    width = len(features("", KINDS[0], 0, 0))
    borders = _borders(vectors, scale, width)
    binned = stage(_binned(vectors, scale, borders), "pii-bins")
    to_learn = binned.where("not held")
    size = to_learn.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
    if min(size["good"], size["bad"]) < MIN_EVIDENCE:
        return Selector()
    share = size["good_weight"] / (size["good_weight"] + size["bad_weight"])
    if size["rows"] <= LOCAL_ROWS:
        counts = _counts(to_learn.toArrow())  # LOCAL_ROWS at most
        scan = functools.partial(histogram, counts)
    else:
        scan = _scan(to_learn, (width, BINS))
    trees = grown(float(np.log((share + 1e-6) / (1 - share + 1e-6))), borders, scan)
    return Selector(trees.on_values(borders), thresholds(binned.where("held"), trees))


FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND_SQL = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of base spans of each kind, their digest, and all spans as ``kind:start:end``.

    The counts and the digest are of base spans; ``spans`` holds base and added ones.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = {f.name: [] for f in FOUND}
            out["doc_id"] = part.column(0)
            for text in strings(part.column(1)):
                base = base_spans(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
                out["spans"].append(_said(_ordered(base + shared.value.added(text, base))))
            yield batch(FOUND, out)

    return map_batches(docs, task, FOUND_SQL)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one mark, of the first."""
    out, at = [], 0
    for kind, start, end in _ordered(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by marks; all other columns as they are, null texts stay null."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(plain))
    place = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = []
            for text in part.column(place).to_pylist():
                if text:
                    base = base_spans(text)
                    text = redacted(text, base + shared.value.added(text, base))
                texts.append(text)
            yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return map_batches(docs, task, docs.schema)
