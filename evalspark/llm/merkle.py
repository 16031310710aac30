"""Merkle manifest of a table: a tree of digests per group, a tree over the groups, and a proof for every row.

H is SHA-256 in lower-case hex of the concatenated inputs, digests as hex text. A row is a leaf: H of its fields, each ``-`` if
null, else the number of its UTF-8 bytes, ``:`` and the value. In a group, leaves ascend by id (null first, ties by leaf); while several
nodes remain, every two consecutive ones, and a last one alone, become their H. The subroots, ordered by group (null first,
bytewise), make a tree of the same kind, whose last node is the root.

*Levels by windows.* The nodes of a group are numbered, and stretches of 256 consecutive ones form a window partition. Level ``j`` of a
stretch lives on the rows whose slot is divisible by ``2**j``: fixed-offset ``lead`` and ``lag`` columns by ``2**j`` hold the siblings,
masked by the slot (first or second child) and by the length of the run (a last child may be alone). The row of the first child
hashes the parent and carries it to the next level. Going back down, one ``lag`` per level hands the path of the parent
to its second child. Eight levels so take one shuffle of digests; the nodes above are 1/256 of the rows and are treated the same way, until one node
is left of every group. Paths then come down from table to table, one join per eight levels.

Scale: a text is read once, and only ids and digests (about 100 bytes a row) are shuffled, twice. A stretch is bounded,
so a group that holds most rows takes as many tasks as its rows need. The driver holds the largest group's size.

Edge cases: null fields are told from empty ones; null ids and null groups are values like any other; repeated rows are leaves of their own;
texts of any length are one leaf; a group of one row has its leaf as subroot, and a single group has it as root; a lone row's proof is
H of nothing; an empty table gives an empty result; other columns are never looked at and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.ranking import numbered
from evalspark.session import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels per shuffle; a window partition holds 2 ** LEVELS nodes.
LEVELS = 8

# An entry of a path: the side of the sibling, then its digest. A node without sibling has ALONE.
LEFT, RIGHT, ALONE = "<", ">", "-"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """H of the fields, each preceded by its length in bytes."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def climb(nodes: DataFrame) -> DataFrame:
    """``LEVELS`` levels over ``grp, slot, run, node``: adds ``_stretch``, the stretch of the node, ``path``, the entries from the node up to the end of its stretch, and
    ``top``, the digest of the stretch on its first row (null on others). Other columns stay."""
    # a column of its own, so that all windows share one shuffle
    out = nodes.withColumn("_stretch", F.shiftright("slot", LEVELS)).withColumn("top", F.col("node"))
    stretch, at = Window.partitionBy("grp", "_stretch").orderBy("slot"), F.col("slot")
    for j in range(LEVELS):
        step = 1 << j
        out = out.select("*", F.lead("top", step).over(stretch).alias("_next"), F.lag("top", step).over(stretch).alias("_back"))
        going = F.col("run") > step  # several nodes remain at this level
        second = at.bitwiseAND(F.lit(step)) != 0
        here = at.bitwiseAND(F.lit(step - 1)) == 0  # the row carries a node of this level
        alone = at + step >= F.col("run")
        entry = (F.when(~going | ~here, F.lit(None).cast("string")).when(second, F.concat(F.lit(LEFT), "_back"))
                 .when(alone, F.lit(ALONE)).otherwise(F.concat(F.lit(RIGHT), "_next")))
        parent = F.when(~going, F.col("top")).when(second | ~here, F.lit(None).cast("string")).otherwise(
            digest(F.col("top"), F.when(alone, F.lit("")).otherwise(F.col("_next"))))
        out = out.select(*[c for c in out.columns if c not in ("top", "_next", "_back")], parent.alias("top"), entry.alias(f"_entry{j}"))
    out = out.withColumn("path", F.array().cast("array<string>"))
    for j in reversed(range(LEVELS)):
        step = 1 << j
        out = out.withColumn("_above", F.lag("path", step).over(stretch))
        second = (at.bitwiseAND(F.lit(step)) != 0) & (at.bitwiseAND(F.lit(step - 1)) == 0)
        above = F.when(second, F.col("_above")).otherwise(F.col("path"))
        own = F.when(F.col(f"_entry{j}").isNull(), F.array().cast("array<string>")).otherwise(F.array(f"_entry{j}"))
        out = out.withColumn("path", F.concat(own, above)).drop("_above", f"_entry{j}")
    return out


def _trees(nodes: DataFrame, largest: int) -> DataFrame:
    """``nodes`` (``grp, slot, run, node`` and others) with ``path`` up to the last node of the group and that node as ``top``.

    ``largest`` is the number of nodes in the largest group.
    """
    climbed = climb(nodes)
    if largest <= 1 << LEVELS:
        # one stretch per group: its first row knows the last node
        whole = Window.partitionBy("grp", "_stretch").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return climbed.select(*nodes.columns, "path", F.first("top").over(whole).alias("top"))
    size = 1 << LEVELS
    upper = stage(climbed.where(F.col("slot") % size == 0).select(
        "grp", F.col("_stretch").alias("slot"), F.ceil(F.col("run") / size).cast("long").alias("run"), F.col("top").alias("node")),
        "merkle-nodes")
    above = stage(_trees(upper, math.ceil(largest / size)).select(
        F.col("grp").alias("_grp"), F.col("slot").alias("_slot"), F.col("path").alias("_path"), F.col("top").alias("_top")), "merkle-paths")
    met = climbed.drop("top").join(above, (F.col("grp") == F.col("_grp")) & (F.col("_stretch") == F.col("_slot")))
    return met.select(*nodes.columns, F.concat("path", "_path").alias("path"), F.col("_top").alias("top"))


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id_col: str = "doc_id",
             keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row: ``id, leaf, subroot, root, path``, and the columns of ``keep`` (expressions over ``rows``).

    ``path`` lists the siblings from the leaf up to the root, each as its side (``<`` left, ``>`` right) and its digest, or ``-``
    for a level where the node is alone; see ``proof`` and ``fold``.
    """
    keep = dict(keep or {})
    leaves = stage(rows.select(
        F.col(id_col).alias("id"), F.col(group).alias("group"), leaf([F.col(f) for f in fields]).alias("node"),
        *[c.alias(f"_keep_{n}") for n, c in keep.items()]), "merkle-leaves")
    slots = numbered(leaves, ["group"], ["id", "node"], "merkle-order")
    sizes = stage(leaves.groupBy("group").agg(F.count("*").alias("rows")), "merkle-groups")
    groups = stage(numbered(sizes, [], ["group"], "merkle-group-order").select(
        "group", F.col("slot").alias("grp"), F.col("run").alias("groups"), "rows"), "merkle-group-numbers")
    largest, count = groups.agg(F.coalesce(F.max("rows"), F.lit(0)), F.count("*")).first()
    # a group that holds most rows is spread by Spark's splitting of skewed joins, if the groups are too many to broadcast
    nodes = stage(slots.join(groups.select(F.col("group").alias("_group"), "grp"), F.col("group").eqNullSafe(F.col("_group"))).drop(
        "group", "_group"), "merkle-slots")
    inner = _trees(nodes, largest)
    subroots = inner.where("slot = 0").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("slot"), F.lit(count).cast("long").alias("run"),
                                              F.col("top").alias("node"))
    upper = stage(_trees(stage(subroots, "merkle-subroots"), count).select(
        F.col("slot").alias("_grp"), F.col("node").alias("subroot"), F.col("path").alias("_path"), F.col("top").alias("root")), "merkle-root-paths")
    return inner.join(upper, F.col("grp") == F.col("_grp")).select(
        "id", F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "_path").alias("path"),
        *[F.col(f"_keep_{n}").alias(n) for n in keep])


def proof(path: str = "path") -> Column:
    """H of the siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.substring(e, 2, 64)), ""), 256)


def fold(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def up(node: Column, entry: Column) -> Column:
        other = F.substring(entry, 2, 64)
        return F.sha2(F.when(entry.startswith(LEFT), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, start, up)


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and what its proofs say of a copy in which rows are altered.

    Altered are the rows whose id, as decimal text, has a CRC-32 that 7 divides: their ``n_chars`` grows by 1 (null stays).
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    altered = leaf([n_chars if f == "n_chars" else F.col(f) for f in FIELDS])
    rows = manifest(docs, keep={"altered": altered})
    folded = fold(F.col("altered"))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof().alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
