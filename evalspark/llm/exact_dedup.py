"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

A frequent-elements pass (Misra-Gries counters, ``DataFrame.freqItems``) names at most
``1 / SUPPORT`` digests that may hold more than ``SUPPORT`` of all rows. Their exact winners are
aggregated, verified and broadcast, so the rows of large groups are decided where they are
read. Every other digest holds less than ``SUPPORT`` of the rows and takes an ordinary shuffle.

Edge cases: a null text is empty; a null id is smaller than any id; of rows that repeat both id
and text one stays; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import stage

# Share of all rows from which a digest is decided by broadcast; bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def digest(text: str) -> Column:
    """SHA-256 of a text, null as empty, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``_digest, _best, _size`` of the digests that hold at least ``support`` of all rows.

    ``rows`` has ``_digest`` and ``_key``; the best row is the one with the largest key.
    """
    named = rows.stat.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest"))
    total = rows.count()
    sizes = rows.join(F.broadcast(named.distinct()), "_digest").groupBy("_digest").agg(
        F.max("_key").alias("_best"), F.count("*").alias("_size"))
    return sizes.where((F.col("_size") > 1) & (F.col("_size") >= support * total))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = stage(
        docs.select(F.col(id_col).cast("long").alias("_id"), digest(text_col).alias("_digest"))
        .select("_digest", F.struct(F.col("_id"), F.monotonically_increasing_id().alias("_row")).alias("_key")),
        "digests",
    )
    heavy = stage(heavy_winners(rows, support), "heavy-digests")
    marked = rows.join(F.broadcast(heavy), "_digest", "left")
    decided = marked.where(F.col("_size").isNotNull())
    rest = marked.where(F.col("_size").isNull()).select("_digest", "_key")
    groups = rest.groupBy("_digest").agg(F.max("_key").alias("_best"), F.count("*").alias("_size"))
    every = decided.unionByName(rest.join(groups, "_digest"))
    return every.select(
        F.col("_key._id").alias("doc_id"),
        F.col("_best._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_key._row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the dropped copies, with its own columns.

    Copies of heavy texts are removed in the reading tasks. The other rows meet the kept
    (digest, id) pairs in one shuffle, after which whole repeated rows are merged.
    """
    chosen = stage(decisions(docs, id_col, text_col, support).where("kept")
                   .select(F.unhex("text_sha256").alias("_digest"), F.col("doc_id").alias("_id"), "group_size"), "kept-digests")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    id_at, text_at = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = rows.withColumns({"_digest": digest(text_at), "_id": F.col(id_at).cast("long")})
    total = chosen.agg(F.sum("group_size")).first()[0] or 0
    heavy = chosen.where((F.col("group_size") > 1) & (F.col("group_size") >= support * total))
    heavy = heavy.select(F.col("_digest").alias("_heavy"), F.col("_id").alias("_heavy_id"))  # at most 1 / support rows
    rows = rows.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy"), "left")
    rows = rows.where(F.col("_heavy").isNull() | F.col("_id").eqNullSafe(F.col("_heavy_id"))).drop("_heavy", "_heavy_id")
    wanted = chosen.select("_digest", F.coalesce("_id", F.lit(0)).alias("_known"), F.col("_id").isNull().alias("_none"))
    rows = rows.withColumns({"_known": F.coalesce("_id", F.lit(0)), "_none": F.col("_id").isNull()})
    kept = rows.join(wanted, ["_digest", "_known", "_none"], "left_semi").dropDuplicates(["_digest", "_known", "_none"])
    return kept.select(*names).toDF(*docs.columns)
