"""Merkle manifest of a dataset, climbed by a recursive query.

Rows become leaves, leaves of one group (a language, say) a binary tree, and the tops of all groups another one,
whose top is the root. A stored node row covers up to LEVELS binary levels of at most WIDTH children, and is linked to
its parent; a climb therefore takes a step for every LEVELS levels. A leaf is proved by joining it with its
node, then with that node's parent, and so on: each step appends the siblings and folds them into the hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import partitions, stored

#: Binary levels that one stored node covers, and the children that it has for that.
LEVELS = 9
WIDTH = 1 << LEVELS
#: Leaves that meet one copy of a node; nodes over more leaves are stored in several copies, for as many tasks.
LOT = 4096
#: The tree over the tops of all groups; the trees of groups are named by `_tree`.
ROOT = "/"
#: Setting that ends recursive queries by a count of rows; climbs have a row per leaf and step.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass(frozen=True)
class Manifest:
    """leaves: the rows given, with their node and place in it; nodes: the rows of all trees, linked to their parents.

    A node has node, lot (the number of the copy), parent, parent_lots (copies of the parent), child (place in the parent),
    levels (hashes of the binary levels inside), top, closes_group (whether top is a subroot).
    """

    leaves: DataFrame
    nodes: DataFrame


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the inputs one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(value: Column | str) -> Column:
    return F.lower(F.hex(value))


def _tree(group: Column) -> Column:
    """Name of a group's tree; names are in the order of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows with `pos`, their place in their tree from 0, and `n`, the number of rows of the tree.

    Rows are range-sorted and written in that order; a count for each tree and range gives the
    places. No tree passes through one task, and the counts are at most trees + ranges rows.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    kept = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    kept = kept.withColumn("part", F.shiftright("row", 33))
    runs = kept.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")
    )
    return kept.join(starts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _paired(hashes: Column) -> Column:
    """The next level: every two hashes, as hex text, become one, a last one alone too."""
    halves = F.slice(F.sequence(F.lit(0), F.lit(WIDTH // 2)), 1, F.ceil(F.size(hashes) / 2).cast("int"))
    text = lambda i: F.coalesce(hex_text(F.get(hashes, i)), F.lit(""))
    return F.transform(halves, lambda i: digest(text(2 * i), text(2 * i + 1)))


def _node(tree: Column, step: int, block: Column) -> Column:
    return F.concat_ws(":", F.lit(str(step)), block.cast("string"), tree)


def _lots(leaves: Column, spark: SparkSession) -> Column:
    """Copies of a node over so many leaves; more than there are tasks are of no use."""
    return F.least(F.ceil(leaves / LOT), F.lit(partitions(spark))).cast("int")


def _nodes(level: DataFrame, step: int) -> DataFrame:
    """Node rows over one level (tree, pos, hash, n, leaves): the binary levels inside the node, and its top."""
    grouped = level.groupBy("tree", F.shiftright("pos", LEVELS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"),
        F.first("n").alias("n"),
        F.first("leaves").alias("leaves"),
    )
    # A tree that ends here halves until one is left; others halve LEVELS times, a last lone node too.
    depth = F.when(F.col("n") > WIDTH, LEVELS).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, depth.cast("int"))
    first = F.array(F.transform("kids", lambda kid: kid["hash"]))
    stack = F.aggregate(steps, first, lambda made, _: F.concat(made, F.array(_paired(F.element_at(made, -1)))))
    over = lambda steps: _lots(F.least("leaves", F.lit(WIDTH**steps)), level.sparkSession)
    up = F.col("n") > WIDTH
    return grouped.withColumn("stack", stack).select(
        "tree",
        "block",
        "n",
        "leaves",
        _node(F.col("tree"), step, F.col("block")).alias("node"),
        over(step + 1).alias("lots"),
        F.when(up, _node(F.col("tree"), step + 1, F.shiftright("block", LEVELS))).alias("parent"),
        F.when(up, over(step + 2)).alias("parent_lots"),
        F.when(up, F.col("block") % WIDTH).cast("int").alias("child"),
        F.slice("stack", 1, F.size("stack") - 1).alias("levels"),
        F.get(F.element_at("stack", -1), F.lit(0)).alias("top"),
        (~up).alias("last"),
    )


def _built(numbered: DataFrame) -> DataFrame:
    """All nodes of the trees over numbered hashes."""
    longest = numbered.agg(F.max("n")).first()[0] or 1
    level = numbered.select("tree", "pos", "hash", "n", "leaves")
    every, step = None, 0
    while True:
        nodes = stored(_nodes(level, step), "merkle-nodes")
        every = nodes if every is None else every.unionByName(nodes)
        if longest <= WIDTH:
            return every
        level = nodes.filter(~F.col("last")).select(
            "tree", F.col("block").alias("pos"), F.col("top").alias("hash"), F.ceil(F.col("n") / WIDTH).alias("n"), "leaves"
        )
        longest, step = -(-longest // WIDTH), step + 1


def build(rows: DataFrame, group: str, order: str) -> Manifest:
    """Trees over rows that have `group`, `order` and `hash`, the leaf as bytes; further columns stay with the leaves.

    Leaves of a group ascend by `order`, null first; rows that are equal there go by their hash. Groups are ordered by
    their bytes as text, null first. An empty table gives no nodes.
    """
    # Repeated rows are told apart by where they are stored, so any number of them can be dealt out.
    named = rows.withColumn("tree", _tree(F.col(group))).withColumn("seq", F.monotonically_increasing_id())
    leaves = _numbered(stored(named, "merkle-leaves"), [F.col(order).asc_nulls_first(), "hash", "seq"]).drop("seq")
    nodes = _built(leaves.withColumn("leaves", F.col("n")))
    tops = nodes.filter("last").select(F.lit(ROOT).alias("tree"), F.col("tree").alias("group_tree"), F.col("top").alias("hash"), "leaves")
    # A node above may stand over all leaves, however many groups it has.
    total = tops.agg(F.sum("leaves")).first()[0] or 0
    ordered = _numbered(tops.drop("leaves"), ["group_tree"]).withColumn("leaves", F.lit(total))
    above_lots = _lots(F.lit(total), rows.sparkSession)
    above = _built(ordered).withColumns({"lots": above_lots, "parent_lots": F.when(F.col("parent").isNotNull(), above_lots)})
    places = ordered.select(
        F.col("group_tree").alias("tree"),
        F.lit(True).alias("last"),
        _node(F.lit(ROOT), 0, F.shiftright("pos", LEVELS)).alias("above"),
        (F.col("pos") % WIDTH).cast("int").alias("place"),
    )
    linked = nodes.join(places, ["tree", "last"], "left").select(
        "node", "lots", F.coalesce("parent", "above").alias("parent"),
        F.coalesce("parent_lots", above_lots).alias("parent_lots"), F.coalesce("child", "place").alias("child"),
        "levels", "top", F.col("last").alias("closes_group"),
    )
    upper = above.withColumn("closes_group", F.lit(False)).select(*linked.columns)
    copies = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
    every = linked.unionByName(upper).select("node", copies, "parent", "parent_lots", "child", "levels", "top", "closes_group")
    at = leaves.withColumns({
        "node": _node(F.col("tree"), 0, F.shiftright("pos", LEVELS)),
        "child": (F.col("pos") % WIDTH).cast("int"),
        "seat": (F.shiftright("pos", LEVELS) % (1 << 30)).cast("int"),
    })
    return Manifest(at.drop("tree", "pos", "n"), stored(every, "merkle-manifest"))


# `seat` deals the leaves over the copies of a node; `lots` is how many copies the next node has.
CLIMB = """
WITH RECURSIVE climb (id, leaf, seat, node, lots, child, folded, siblings, subroot, root) AS (
  SELECT id, hash, seat, node, 1, child, claimed, X'', CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT id, leaf, seat, parent, parent_lots, place, up.hash, up.siblings,
         CASE WHEN closes_group THEN top ELSE subroot END, CASE WHEN parent IS NULL THEN top END
  FROM (
    SELECT c.id, c.leaf, c.seat, c.subroot, n.parent, n.parent_lots, n.child AS place, n.top, n.closes_group,
      aggregate(n.levels, named_struct('hash', c.folded, 'at', c.child, 'siblings', c.siblings), (below, level) -> named_struct(
        'hash', unhex(sha2(lower(CASE WHEN below.at % 2 = 1 THEN concat(hex(get(level, below.at - 1)), hex(below.hash))
                                      ELSE concat(hex(below.hash), coalesce(hex(get(level, below.at + 1)), '')) END), 256)),
        'at', shiftright(below.at, 1),
        'siblings', concat(below.siblings, coalesce(get(level, below.at ^ 1), X'')))) AS up
    FROM climb c JOIN {nodes} n ON n.node = c.node AND n.lot = c.seat % c.lots
  )
)
SELECT id, leaf, subroot, root, siblings, folded FROM climb WHERE node IS NULL
"""


@contextmanager
def _without_row_limit(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def climbed(manifest: Manifest, key: str, claimed: str) -> DataFrame:
    """id, leaf, subroot, root, siblings, folded of every leaf: the hash in `claimed`, folded with its siblings up to the root.

    All hashes are bytes; siblings holds those on the way, one after the other. A leaf is genuine where folded is the root.
    """
    leaves = manifest.leaves.select(F.col(key).alias("id"), "hash", F.col(claimed).alias("claimed"), "seat", "node", "child")
    spark = leaves.sparkSession
    with _without_row_limit(spark):
        return stored(spark.sql(CLIMB, leaves=leaves, nodes=manifest.nodes), "merkle-climb")


def verified_documents(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """Manifest of docs (doc_id, source, lang, n_chars, text) by lang, and the proof of every row against it.

    tampered: which rows are claimed with the values in `change` in place of their own. Returns doc_id, leaf, subroot,
    root, proof_sha256, folded_root, verified. Null values are part of a leaf like any other; null doc_ids come
    first and null langs form a group of their own; rows with equal doc_id go by their leaf; empty texts and texts of
    any length are hashed whole; an empty table gives no rows; extra columns are left out.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    own = [encoded(docs[f]) for f in fields]
    other = [encoded(change.get(f, docs[f])) for f in fields]
    leaf = digest(*own)
    claimed = F.when(tampered, digest(*other)).otherwise(leaf)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
        leaf.alias("hash"), claimed.alias("claimed"),
    )
    proofs = climbed(build(rows, "lang", "doc_id"), "doc_id", "claimed")
    return proofs.select(
        F.col("id").alias("doc_id"),
        hex_text("leaf").alias("leaf"),
        hex_text("subroot").alias("subroot"),
        hex_text("root").alias("root"),
        F.sha2(hex_text("siblings"), 256).alias("proof_sha256"),
        hex_text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def manifest_proofs(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """Proofs of docs where n_chars of the rows whose crc32 of the id is divisible by `modulus` is claimed one too high."""
    chosen = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % modulus == 0, F.lit(False))
    return verified_documents(docs, chosen, {"n_chars": F.try_add(docs["n_chars"].cast("long"), F.lit(1))})
