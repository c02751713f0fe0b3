"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, and racks have shards; each shard has a weight, and a node's weight is the sum of those
below it. A document descends from the root: at every node each child draws a straw, the logarithm of a hash of (key, child)
over the child's weight, and the shortest straw wins. So a shard's share is its weight's, and the key and the tree alone decide.

A straw depends on its own child only. A weight that falls therefore moves rows out of that subtree alone, and leaves all others
where they are. Weight that is added later, a new shard or more weight for an old one, enters the tree as a layer with straws of
its own: the rows that a new layer's straw wins go down that layer's path, to what was added and nowhere else.

Everything is one expression on the key, so placing rows needs no shuffle. Only their numbers within the shards do (``placed``), and
there a shard is spread over as many tasks as its rows need.

Null keys count as one key, the empty string, so all rows without a key go to one shard, as all rows of one key do. Null and empty
texts have no bytes. Rows that repeat a key are numbered apart. An empty table gives no rows. Only key and text are read, so other
columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import located, packed, positions, stored, text_or_empty

#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Hexadecimal digits of a draw, so that it is exact in a double.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    """A shard's weight in one layer. A shard whose weight grew has a leaf in every layer that gave it some."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    layer: int = 0

    def path(self) -> list[str]:
        """The names of the nodes from the root's child down to this leaf."""
        names = [f"{self.layer}/{self.region}", self.rack, str(self.shard)]
        return ["/".join(names[:i + 1]) for i in range(len(names))]


Tree = list[Leaf]


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Shards of weight one, numbered from 0, so many in each rack and so many racks in each region."""
    return [
        Leaf(f"region{r}", f"rack{k}", (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards)
    ]


def grown(tree: Tree, region: str, rack: str, shard: int, weight: float = 1.0) -> Tree:
    """The tree with a new shard, or with more weight for an old one. Rows move into that shard only."""
    return [*tree, Leaf(region, rack, shard, weight, 1 + max((leaf.layer for leaf in tree), default=-1))]


def shrunk(tree: Tree, shard: int, share: float) -> Tree:
    """The tree in which a shard has only so much of its weight; none for 0. Rows move out of its shard, rack or region only."""
    if not 0 <= share <= 1:
        raise ValueError("a share is between 0 and 1")
    left = [replace(leaf, weight=leaf.weight * share) if leaf.shard == shard else leaf for leaf in tree]
    return [leaf for leaf in left if leaf.weight > 0]


def _children(tree: Tree) -> dict[str, dict[str, float]]:
    """The children of every inner node, with their weights."""
    if not tree or any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("a tree needs shards of positive weight")
    if any("/" in name for leaf in tree for name in (leaf.region, leaf.rack)):
        raise ValueError("names of regions and racks have no slash")
    found: dict[str, dict[str, float]] = {}
    for leaf in tree:
        at = ""
        for child in leaf.path():
            children = found.setdefault(at, {})
            children[child] = children.get(child, 0.0) + leaf.weight
            at = child
    return found


def draw(key: Column, child: Column) -> Column:
    """A number between 0 and 1, both excluded, that key and child decide."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child)), 1, DRAW_DIGITS), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def path_of(key: Column, tree: Tree) -> Column:
    """The path, ``layer/region/rack/shard``, of the shard that a key belongs to."""
    nodes = _children(tree)
    known = F.create_map(*[
        c for name, children in nodes.items()
        for c in (F.lit(name), F.array(*[F.struct(F.lit(child).alias("name"), F.lit(weight).alias("weight")) for child, weight in children.items()]))
    ])
    hashed = F.coalesce(key.cast("string"), F.lit(""))

    def shortest(node: Column) -> Column:
        straws = F.transform(
            F.element_at(known, node), lambda c: F.struct((-F.ln(draw(hashed, c["name"])) / c["weight"]).alias("straw"), c["name"].alias("name")),
        )
        return F.array_min(straws)["name"]

    at = F.lit("")
    for _ in ("region", "rack", "shard"):
        at = shortest(at)
    return at


def shard_of(key: Column, tree: Tree) -> Column:
    return F.element_at(F.split(path_of(key, tree), "/"), -1).cast("int")


def placed(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", after: Tree | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard (its shard in ``after``), file, row: one row per document.

    Slots are numbered from 0 in every shard, by key, null first, and by file and row where keys are alike.
    """
    body = text_or_empty(text)
    rows = located(docs.select(key, text)).select(
        F.col(key).alias("key"), F.octet_length(body).cast("bigint").alias("bytes"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.col("__file").alias("file"), F.col("__row").alias("row"), shard_of(F.col(key), tree).alias("shard"),
        (F.lit(None).cast("int") if after is None else shard_of(F.col(key), after)).alias("grown_shard"),
    )
    numbered = positions(stored(rows, "sharded"), ["shard"], [F.col("key").asc_nulls_first(), F.col("file"), F.col("row")], "slot")
    return numbered.select(
        F.col("key").alias(key), (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", "shard", "slot", "grown_shard", "file", "row"
    )


def moves(docs: DataFrame, before: Tree, after: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """from_path, to_path, rows, bytes: what a change of the tree moves, without the layers; at most a row per two shards."""
    plain = lambda tree: F.substring_index(path_of(F.col(key), tree), "/", -3)
    size = F.octet_length(text_or_empty(text)).cast("bigint") + OVERHEAD
    rows = docs.select(plain(before).alias("from_path"), plain(after).alias("to_path"), size.alias("size"))
    return rows.filter("from_path <> to_path").groupBy("from_path", "to_path").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, folder: str, tree: Tree, key: str = "doc_id") -> None:
    """The documents with all their columns in a folder ``shard=N`` per shard. A shard's files are written by several tasks."""
    if "shard" in docs.columns:
        raise ValueError("the documents have a column named shard")
    rows = packed(docs).withColumn("shard", shard_of(F.col("__doc")[key], tree))
    rows.repartitionByRange("shard", "__file", "__row").select("__doc.*", "shard").write.partitionBy("shard").parquet(folder)
