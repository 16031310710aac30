"""Contiguous shards of nearly equal bytes, in DataFrame functions only.

The size of a document is the UTF-8 bytes of its text plus one. Documents are ordered by the SHA-256 of their text,
then by id, so equal texts lie side by side. Totals per partition of that order give every document the number of bytes
before it, and the order is cut at equal targets: a document belongs to shard ``s`` when its middle byte lies in the ``s``-th
of ``shards`` equal parts of all bytes. Shards are therefore contiguous, and a boundary is off its target by half of the
document that lies on it, however large the table or a group of copies is.

A group of equal texts that lies across a cut goes whole to the side of its middle, when it is no larger than ``slack`` of a
shard; a larger group is divided at the cut. At most ``shards - 1`` groups are looked at for that.

Scale: a text is read once; its digest, size, CRC and id are shuffled (about 70 bytes a row), the text is not. What is added up
across partitions is one row per partition; what is broadcast is at most one row per shard.

Edge cases: a null text is empty (size 1, CRC 0); a null id comes first; repeated rows are rows like any other and get slots of
their own; a text longer than a shard fills it and neighbours may stay empty, as do shards of a table with
fewer documents than shards; an empty table gives an empty result; other columns are never looked at, unless ``whole_rows`` asks for
them, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.ranking import numbered
from evalspark.session import stage

SHARDS = 16
#: Largest group of equal texts that is kept whole across a cut, as a share of a shard's bytes.
SLACK = 0.01


def _whole_groups(rows: DataFrame, shards: int, slack: float) -> DataFrame:
    """``_group, _side``: the shards of small groups of equal texts that lie across a cut; at most one row per cut."""
    ends = rows.groupBy("shard").agg(F.min_by("_digest", "slot").alias("_head"), F.max_by("_digest", "slot").alias("_tail"))
    heads = ends.select(F.col("_head").alias("_group"), F.col("shard").alias("_next"))
    tails = ends.select(F.col("_tail").alias("_group"), "shard")
    across = heads.join(tails, "_group").where("shard < _next").select("_group").distinct()
    extent = rows.join(F.broadcast(across), rows["_digest"] == across["_group"]).groupBy("_group").agg(
        F.min("before").alias("_from"), F.max(F.col("before") + F.col("size")).alias("_to"), F.max("before_total").alias("_all"))
    small = (F.col("_to") - F.col("_from")) * shards <= F.col("_all") * F.lit(slack)
    side = F.floor((F.col("_from") + F.col("_to")) * shards / (2 * F.col("_all")))
    return extent.where(small).select("_group", side.cast("int").alias("_side"))


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text",
           whole_rows: bool = False) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; ``slot`` counts from 0 inside a shard.

    With ``whole_rows`` the documents come along as a struct ``document``, ready to be written by shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_digest"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if whole_rows else []))
    placed = numbered(stage(rows, "shard-sizes"), [], ["_digest", "doc_id"], "shard-order", sums={"size": "before"})
    # integers throughout: twice the middle byte against twice the total
    part = F.expr(f"((2 * before + size) * {int(shards)}) div (2 * before_total)").cast("int")
    placed = stage(placed.withColumn("shard", part), "shard-positions")
    whole = stage(_whole_groups(placed, shards, slack), "shard-groups")
    cut = placed.join(F.broadcast(whole), F.col("_digest") == F.col("_group"), "left").withColumn(
        "shard", F.coalesce("_side", "shard"))
    firsts = cut.groupBy(F.col("shard").alias("_shard")).agg(F.min("slot").alias("_first"))
    return cut.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") - F.col("_first")).alias("slot"), *(["document"] if whole_rows else []))
