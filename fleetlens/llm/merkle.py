"""A Merkle manifest of a table of documents.

Every row is a leaf. The leaves of a language, by rising id, are the lowest level of its tree; consecutive pairs give the next
level until one node is left, the language's subroot, and the subroots give the root in the same way. A level is a table of nodes
(tree, place, digest). Each level equijoins its nodes with themselves on the computed place of the sibling, ``place XOR 1``; of
every two, the one in slot zero emits the parent. A last node without a sibling is hashed alone.

The proof of a leaf, its siblings from the bottom up, comes from walking the levels down again: a node's path is its own sibling
and then the path of its parent, met by the place halved. So each level is moved once up and once down, twice the leaves in all, and
no tree, subtree or group is ever held in one task. Texts are read once and never moved.

``tampered_leaves`` says which rows were changed after the manifest was made; a changed leaf is folded with the original siblings
and must not give the root.

Defined results: rows without an id come first in their language; rows equal in language and id are ordered by their leaf, and rows
equal in that too are alike, each with a place of its own. A null language is a tree of its own, before all others. A null n_chars
can't be tampered with. The proof of a table of one row is the digest of the empty text. Other columns are ignored; an empty table
gives an empty result. Very long texts are digested as they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, settle

TAMPER = 7
LEVELS_IN_A_PLAN = 8  # on the way down, a table is written after so many levels


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered (the leaf after tampering; null where nothing changes), digests in binary."""

    def leaf(n_chars: Column) -> Column:
        return F.unhex(digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text"))))

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # wide enough for the greatest long
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), "doc_id",
        leaf(F.col("n_chars")).alias("leaf"), F.when(changed & F.col("n_chars").isNotNull(), leaf(more)).alias("tampered"),
    )


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels with more than one node, each with the siblings of its nodes, and the root of every tree.

    ``nodes`` (tree, place, members, node, and more, which the lowest level keeps) is a written table. Roots are (tree, members of
    the lowest level, depth, node).
    """
    levels, roots = [], [nodes.filter("members = 1").select("tree", F.lit(0).alias("depth"), "node")]
    most = nodes.agg(F.max("members")).first()[0] or 0
    while most > 1:
        live = nodes.filter("members > 1")
        others = live.select("tree", F.col("place").alias("beside"), F.col("node").alias("sibling"))
        met = live.withColumn("beside", F.col("place").bitwiseXOR(F.lit(1).cast("long"))).join(others, ["tree", "beside"], "left")
        level = settle(met.drop("beside"), f"{name}-level")
        levels.append(level)
        pair = digest(F.lower(F.hex("node")), F.coalesce(F.lower(F.hex("sibling")), F.lit("")))
        nodes = level.filter(F.col("place").bitwiseAND(F.lit(1).cast("long")) == 0).select(
            "tree", F.shiftright("place", 1).alias("place"), F.shiftright(F.col("members") + 1, 1).alias("members"), F.unhex(pair).alias("node")
        )
        roots.append(nodes.filter("members = 1").select("tree", F.lit(len(levels)).alias("depth"), "node"))
        most = (most + 1) // 2
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, settle(found, f"{name}-roots")


def descend(levels: list[DataFrame], starts: DataFrame, name: str) -> DataFrame:
    """Every node of the lowest level with more than one node in its tree, with the columns of ``starts`` (tree, depth, path, and more).

    ``path`` grows on the way down: a node's own sibling, whether that stands to the left, and then its parent's path.
    """
    kept = [c for c in starts.columns if c not in ("tree", "depth", "path")]
    above = None
    for k in reversed(range(len(levels))):
        entering = starts.filter(F.col("depth") == k + 1).select("tree", F.lit(0).cast("long").alias("parent"), F.col("path").alias("rest"), *kept)
        if above is not None:
            entering = above.select("tree", F.col("place").alias("parent"), F.col("path").alias("rest"), *kept).unionByName(entering)
        step = F.struct((F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1).alias("left"), "sibling")
        own = levels[k].withColumn("parent", F.shiftright("place", 1))
        # A merge join keeps both sides spread; the upper levels are small files that would otherwise pull all below into their task.
        above = own.join(entering.hint("merge"), ["tree", "parent"]).withColumn("path", F.concat(F.array(step), F.col("rest")))
        above = above.drop("parent", "rest", "sibling")
        if k and (len(levels) - k) % LEVELS_IN_A_PLAN == 0:
            above = settle(above, f"{name}-paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    placed = numbered(leaves(docs), "tree", ["doc_id", "leaf"], "merkle-leaves")
    lowest = settle(placed.withColumn("node", F.col("leaf")), "merkle-nodes")
    levels, subroots = climb(lowest, "merkle")

    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "depth", "node")
    tops = settle(numbered(named, "tree", ["member"], "merkle-subroots"), "merkle-tops")
    top_levels, top_roots = climb(tops, "merkle-top")
    root = top_roots.first()  # one row
    path_type = "array<struct<left: boolean, sibling: binary>>"
    nothing = F.array().cast(path_type)
    if top_levels:
        above = descend(top_levels, top_roots.select("tree", "depth", nothing.alias("path")), "merkle-top")
    else:
        above = tops.withColumn("path", nothing)
    starts = settle(above.select(F.col("member").alias("tree"), "depth", "path", F.col("node").alias("subroot")), "merkle-starts")

    carried = ["doc_id", "leaf", "tampered", "subroot", "path"]
    rows = lowest.filter("members = 1").join(starts, "tree").select(*carried)
    if levels:
        rows = descend(levels, starts, "merkle").select(*carried).unionByName(rows)

    def text(value: Column) -> Column:
        return F.lower(F.hex(value))

    siblings = F.transform("path", lambda x: F.struct(x["left"].alias("left"), F.coalesce(text(x["sibling"]), F.lit("")).alias("sibling")))
    folded = F.aggregate(
        siblings, text(F.coalesce("tampered", "leaf")),
        lambda node, x: F.when(x["left"], digest(x["sibling"], node)).otherwise(digest(node, x["sibling"])),
    )
    return rows.select(
        "doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"),
        F.lit(root["node"].hex() if root else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform(siblings, lambda x: x["sibling"]), "").cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
