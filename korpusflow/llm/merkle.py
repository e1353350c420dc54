"""Merkle manifest of a dataset: checkpoint every few levels and recompute the rest.

Each language's rows are the leaves of a tree, in the order of their ids; the trees' roots, in the order of the languages,
are the leaves of one tree more. Two consecutive nodes become their hash, a last one alone its own. Only every `step`-th
level is kept as a table (tree, pos, hash, size). Whoever needs a proof takes an aligned subtree of at most 2^step stored
nodes, recomputes the levels between, gives each node its siblings, joined with the path above the subtree, and forgets the
levels. So no group is larger than 2^step nodes, whatever the size of a language.

Places in a tree come from a range partitioning by language and id: a row's place is its number within its partition and
the rows of the partitions before, so no window ever sees a whole language.

Cases: a null value is hashed as `-`, so it differs from an empty text; rows of a null language are a tree of their own,
the first; rows without an id come first and are never tampered with; rows that share an id are ordered by their leaf, rows
that repeat are leaves of their own (with equal leaves the order makes no difference); a tree of one leaf is that leaf, a
lone tree's root is the root; a long text is hashed whole; an empty table gives an empty one; further columns, whatever
their names, are not hashed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import discard, hot_keys, materialize, spread_join

#: The columns that a leaf holds, in order. Levels between two stored ones.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 8
#: A step of the way to the root: the other node of the run (null: none) and whether it is on the left.
PATH = "array<struct<hash:string,left:boolean>>"


class Forest(NamedTuple):
    """Stored levels of trees, lowest first: (tree, pos, hash, size), size being the tree's number of leaves."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", F.col("hash").alias("root"))


class Manifest(NamedTuple):
    leaves: DataFrame  # tree, pos, size, doc_id, leaf, tampered
    trees: Forest
    top: Forest


def part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*(part(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def hashed_leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, tampered: the leaf of what a tampered row would be (the leaf itself, where none is)."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(*FIELDS).select("lang", "doc_id", leaf_hash().alias("leaf"), F.when(hit, leaf_hash(n_chars=more)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str], number: str, name: str) -> DataFrame:
    """The rows, stored, with their number in an order, from 0. Rows equal in it are dealt to partitions by their place."""
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    cut = spread.repartitionByRange(*order, "__tie").sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).drop("__tie")
    stored = materialize(cut, name)
    placed = stored.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    # One row a partition, of which there are as many as Spark made tasks.
    counts, before, total = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()), [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    out = placed.join(F.broadcast(offsets), "__part").withColumn(number, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
    out.__dict__["_scratch"] = stored.__dict__["_scratch"]
    return out


def folded(hashes: Column) -> Column:
    """The level above: each two nodes' hash, a last one's alone."""
    pair = lambda i: F.sha2(F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), pair)


def depth_left(step: int, level: int) -> Column:
    """How many levels a subtree of stored nodes is folded: `step`, or as many as are left below the root."""
    depth = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(step), depth - level))


def subtrees(nodes: DataFrame, step: int, level: int, *carried: str) -> DataFrame:
    """tree, above (the subtree's place), size, nodes (in order) and the levels h0 to h<step>: null above its root."""
    members = F.array_sort(F.collect_list(F.struct("pos", "hash", *carried)))
    grouped = nodes.groupBy("tree", F.shiftright("pos", step).alias("above"), "size").agg(members.alias("nodes"))
    out = grouped.withColumn("folds", depth_left(step, level)).withColumn("h0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(step):
        out = out.withColumn(f"h{k + 1}", F.when(F.col("folds") > k, folded(F.col(f"h{k}"))))
    return out


def grow(leaves: DataFrame, step: int, name: str) -> Forest:
    """The stored levels of trees with leaves (tree, pos, hash, size): level 0, then every `step`-th up to the roots."""
    levels, level = [leaves], 0
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1 << level:
        nodes = subtrees(levels[-1], step, level)
        top = F.coalesce(*(F.get(f"h{k}", F.lit(0)) for k in range(step, -1, -1)))
        levels.append(materialize(nodes.select("tree", F.col("above").alias("pos"), top.alias("hash"), "size"), f"{name}-{level + step}"))
        level += step
    return Forest(levels)


def extracted(nodes: DataFrame, above: DataFrame, step: int, level: int, *carried: str) -> DataFrame:
    """tree, pos, hash, carried columns and path (siblings up to the root) of stored nodes of a level, given the path of
    each subtree's root: `above` has tree, above, path, and what else all nodes below are to have."""
    whole = subtrees(nodes, step, level, *carried).join(above, ["tree", "above"])

    def own(pos: Column) -> Column:
        at = pos.bitwiseAND((1 << step) - 1).cast("int")
        place = lambda k: F.shiftright(at, k)
        sibling = lambda k: F.struct(F.get(f"h{k}", place(k).bitwiseXOR(F.lit(1))).alias("hash"), (place(k).bitwiseAND(F.lit(1)) == 1).alias("left"))
        return F.slice(F.array(*(sibling(k) for k in range(step))), F.lit(1), F.col("folds")).cast(PATH)

    each = F.transform("nodes", lambda x: F.struct(*(x[c].alias(c) for c in ("pos", "hash", *carried)), F.concat(own(x["pos"]), "path").alias("path")))
    further = [c for c in above.columns if c not in ("tree", "above", "path")]
    return whole.select("tree", *further, F.inline(each))


def paths_above(forest: Forest, tops: DataFrame, step: int) -> DataFrame:
    """tree, above, path of the roots of the lowest stored subtrees, from the path of each tree's root (tree, path)."""
    paths = tops.select("tree", F.lit(0).cast("long").alias("above"), "path")
    for no in range(len(forest.levels) - 2, 0, -1):
        found = extracted(forest.levels[no], paths, step, no * step)
        paths = found.select("tree", F.col("pos").alias("above"), "path")
    return paths


def manifest(docs: DataFrame, step: int = STEP) -> Manifest:
    """The trees of all rows. Texts are read once; all later tables hold hashes."""
    hashed = materialize(hashed_leaves(docs), "merkle-leaves")
    placed = numbered(hashed, ["lang", "doc_id", "leaf"], "no", "merkle-order")
    discard(hashed)
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    sizes = materialize(placed.groupBy("lang").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-sizes")
    trees = numbered(sizes, ["lang"], "tree", "merkle-trees").withColumn("key", key)
    hot = hot_keys(trees, ["key"], "size")
    joined = spread_join(placed.withColumn("key", key), trees.select("key", "tree", "first", "size"), ["key"], hot, F.col("no"))
    leaves = materialize(joined.select("tree", (F.col("no") - F.col("first")).alias("pos"), "size", "doc_id", "leaf", "tampered"), "merkle-placed")
    discard(placed)
    forest = grow(leaves.select("tree", "pos", F.col("leaf").alias("hash"), "size"), step, "merkle-nodes")
    count = sizes.count()
    tops = forest.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("hash"), F.lit(count).cast("long").alias("size"))
    return Manifest(leaves, forest, grow(materialize(tops, "merkle-roots"), step, "merkle-top"))


def proofs(built: Manifest, step: int = STEP) -> DataFrame:
    """tree, pos, doc_id, leaf, tampered, subroot, root and path (siblings from the leaf to the root) of every leaf."""
    none = F.array().cast(PATH)
    root = built.top.roots
    above_top = paths_above(built.top, root.select("tree", none.alias("path")), step)
    of_trees = extracted(built.top.levels[0], above_top, step, 0).join(root, "tree")
    tops = materialize(of_trees.select(F.col("pos").alias("tree"), F.col("hash").alias("subroot"), "path", "root"), "merkle-tops")
    above = paths_above(built.trees, tops, step).join(tops.select("tree", "subroot", "root"), "tree")
    nodes = built.leaves.withColumnRenamed("leaf", "hash")
    return extracted(nodes, above, step, 0, "doc_id", "tampered").withColumnRenamed("hash", "leaf")


def climb(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    up = lambda h, s: F.sha2(F.when(s["hash"].isNull(), h).when(s["left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256)
    return F.aggregate(path, leaf, up)


def verified(docs: DataFrame, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row: what its proof says of a tampered row
    (of the row itself, where none is tampered with)."""
    found = proofs(manifest(docs, step), step)
    siblings = F.array_join(F.transform("path", lambda s: s["hash"]), "")
    folded_root = climb(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
