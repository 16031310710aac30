"""Deterministic judges used by the registered queries, each with the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.scalars import argmax_label
from evalspark.operators.scoring import ColumnScorer
from evalspark.sources.answers import as_records

MODEL = "lexicon-1"
JUNK = "[^#$%*&]"
# Word parts that hint at a language.
HINTS = {"de": "sch|ich|und", "en": "the|and|ing", "es": "ción|los|ado", "fr": "eau|que|ment"}


def quality_judge() -> ColumnScorer:
    """P(good) falls with the share of junk characters in the whole state."""
    junk = F.length(F.regexp_replace("state_json", JUNK, ""))
    z = F.lit(1.0) - F.lit(100.0) * junk / F.length("state_json")
    return ColumnScorer(p_yes=F.round(1.0 / (1.0 + F.exp(-z)), 6))


def quality_sql(state: str) -> str:
    return f"round(1.0 / (1.0 + exp(-(1.0 - 100.0 * length(regexp_replace({state}, '{JUNK}', '', 'g')) / length({state})))), 6)"


class LanguageJudge:
    """Probabilities from the counts of each language's word parts in the whole state."""

    def score(self, requests: DataFrame) -> DataFrame:
        counts = [F.regexp_count("state_json", F.lit(p)).alias(f"c_{l}") for l, p in HINTS.items()]
        counted = requests.select("request_key", "model", *counts)
        total = sum([F.col(f"c_{l}") for l in HINTS], F.lit(float(len(HINTS))))
        chances = [F.round((F.col(f"c_{l}") + 1.0) / total, 6).alias(f"p_{l}") for l in HINTS]
        scored = counted.select("request_key", "model", *chances)
        top = F.greatest(*[f"p_{l}" for l in HINTS])
        pairs = [x for l in HINTS for x in (F.lit(l), F.col(f"p_{l}"))]
        return as_records(
            scored.select(
                "request_key", "model", argmax_label([F.col(f"p_{l}") for l in HINTS], list(HINTS)).alias("choice"),
                top.alias("confidence"), F.create_map(*pairs).alias("probabilities"),
            )
        )


def language_sql(source: str, state: str, keep: str) -> str:
    """A query over ``source`` with the kept columns, p_<label>, choice and confidence."""
    counts = ", ".join(f"len(regexp_extract_all({state}, '{p}')) AS c_{l}" for l, p in HINTS.items())
    total = " + ".join(f"c_{l}" for l in HINTS)
    chances = ", ".join(f"round((c_{l} + 1.0) / ({total} + {len(HINTS)}.0), 6) AS p_{l}" for l in HINTS)
    top = "greatest(" + ", ".join(f"p_{l}" for l in HINTS) + ")"
    choice = " ".join(f"WHEN p_{l} = {top} THEN '{l}'" for l in HINTS)
    return (
        f"SELECT *, CASE {choice} END AS choice, {top} AS confidence FROM "
        f"(SELECT {keep}, {chances} FROM (SELECT {keep}, {counts} FROM {source}))"
    )


class VectorJudge:
    """Class probabilities of a vector from a fixed rule on its first dimensions (not a good one)."""

    CLASSES = 10

    def score(self, requests: DataFrame) -> DataFrame:
        values = F.from_json(F.get_json_object("state_json", "$.values"), "array<double>")
        read = requests.select("request_key", "model", values.alias("v"))
        weights = [F.exp(4.0 * F.col("v")[i]).alias(f"w_{i}") for i in range(self.CLASSES)]
        weighed = read.select("request_key", "model", *weights)
        total = sum([F.col(f"w_{i}") for i in range(1, self.CLASSES)], F.col("w_0"))
        chances = [(F.col(f"w_{i}") / total) for i in range(self.CLASSES)]
        labels = [str(i) for i in range(self.CLASSES)]
        pairs = [x for l, c in zip(labels, chances) for x in (F.lit(l), c)]
        return as_records(
            weighed.select(
                "request_key", "model", argmax_label([F.col(f"w_{i}") for i in range(self.CLASSES)], labels).alias("choice"),
                F.greatest(*chances).alias("confidence"), F.create_map(*pairs).alias("probabilities"),
                F.lit(0.25).alias("latency_s"), F.lit(10).alias("input_tokens"),
            )
        )
