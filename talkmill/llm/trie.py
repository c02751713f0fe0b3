"""The prefix trie of conversations, by digests of fixed-length blocks of turns.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Conversations are cut into blocks
of BLOCK turns and grouped by successive block digests: rows are one per conversation and block, and become one per distinct block,
with the block it follows, before any turn is looked at. Where a block has no sibling, its turns are nodes with its members. Only where
siblings diverge are their turns compared, one row per distinct block and turn, whatever number of conversations hold it.

A prefix's digest is the exclusive or of 128-bit hashes of (position, turn digest), keyed with a number drawn anew in each call; so
prefixes of a conversation of any length come from prefix sums over its blocks, in sections of SECTION blocks.

Sums over subtrees need no walk. With (members - 1) times the bytes of each node below, a subtree saves what its members' turns take
from there on, less what its distinct nodes take; and a node belongs to its smallest member, which owns the last part of its own path.
So both are sums over members, and they go through the same grouping in a second pass. A leaf is counted at the member that owns it.

Turn numbers only order turns, null first, and equal ones by the turn's digest; null role or text is empty. Rows without a conversation
id belong to no conversation and are left out. An id in ``convs`` without turns is a member of the root alone. A table without
conversations has no nodes, not even a root. Only the four columns are read. One conversation may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import positions, stored, text_or_empty

#: Turns of a block.
BLOCK = 4
#: Blocks of a section of a conversation, within which prefixes are summed in one task.
SECTION = 256
#: Conversation ids that are written into one piece of a node's list.
LIST_RANGE = 65536
#: A node's identity: its depth and the two halves of its prefix digest. The root's are all zero.
NODE = ["depth", "x", "y"]


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest, bytes (of the text in UTF-8): one row per turn, without its text."""
    said, by = text_or_empty(text), text_or_empty(role)
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.octet_length(said).cast("bigint").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.length(by), F.lit(":"), by, said), 256)).alias("digest"),
    )
    placed = positions(stored(rows, "turns"), ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], "no")
    return placed.select("conv", (F.col("no") + 1).alias("pos"), "digest", "bytes")


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def block_rows(turns: DataFrame, block: int, seed: int) -> DataFrame:
    """conv, begin (turns before the block), size, px, py (digest of the prefix before it), x1, y1, b1, ... (hash and bytes of each
    turn, null behind the last), after (bytes of the conversation's turns behind the block), last: one row per block."""
    places = range(1, block + 1)
    mixed = turns.select(
        "conv", "bytes", (F.col("pos") - 1).alias("at"),
        F.xxhash64(F.lit(seed), "pos", "digest").alias("x"), F.xxhash64(F.lit(~seed), "digest", "pos").alias("y"),
    )
    mixed = mixed.withColumn("block", F.floor(F.col("at") / block)).withColumn("section", F.floor(F.col("block") / SECTION))
    here = lambda c, i: F.max(F.when(F.col("at") % block == i - 1, F.col(c)))
    blocks = mixed.repartition("conv", "section").groupBy("conv", "section", "block").agg(
        F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"),
        *[here(c, i).alias(f"{n}{i}") for i in places for c, n in (("x", "x"), ("y", "y"), ("bytes", "b"))],
    )
    order = Window.partitionBy("conv", "section").orderBy("block")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    blocks = blocks.select(
        "*", zero(F.bit_xor("bx").over(before)).alias("px"), zero(F.bit_xor("by").over(before)).alias("py"),
        zero(F.sum("bytes").over(behind)).alias("after"), F.lead("block").over(order).isNull().alias("last"),
    )
    blocks = stored(blocks, "blocks", "zstd")
    # What stands before and behind a section matters only to conversations of more than one.
    long_ones = blocks.filter("section > 0").select("conv").distinct()
    sections = blocks.join(long_ones, "conv", "left_semi").groupBy("conv", "section").agg(
        F.bit_xor("bx").alias("sx"), F.bit_xor("by").alias("sy"), F.sum("bytes").alias("sb"),
    )
    along = Window.partitionBy("conv").orderBy("section")
    before, behind = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    sections = sections.select(
        "conv", "section", zero(F.bit_xor("sx").over(before)).alias("ox"), zero(F.bit_xor("sy").over(before)).alias("oy"),
        zero(F.sum("sb").over(behind)).alias("more"), F.lead("section").over(along).isNotNull().alias("goes_on"),
    )
    return blocks.join(stored(sections, "sections"), ["conv", "section"], "left").select(
        "conv", (F.col("block") * block).alias("begin"), "size", F.col("px").bitwiseXOR(zero(F.col("ox"))).alias("px"),
        F.col("py").bitwiseXOR(zero(F.col("oy"))).alias("py"), *[f"{n}{i}" for i in places for n in "xyb"],
        (F.col("after") + zero(F.col("more"))).alias("after"), (F.col("last") & ~F.coalesce("goes_on", F.lit(False))).alias("last"),
    )


def node_at(block: int, places: int | None = None) -> list[Column]:
    """The identity of the node at the end of a block, or of its first ``places`` turns."""
    upto = range(1, (places or block) + 1)
    halves = [_xor([F.col(f"p{h}"), *[F.coalesce(F.col(f"{h}{i}"), F.lit(0).cast("bigint")) for i in upto]]) for h in "xy"]
    depth = F.col("begin") + (F.col("size") if places is None else F.lit(places))
    return [depth.cast("bigint").alias("depth"), halves[0].alias("x"), halves[1].alias("y")]


def distinct_blocks(blocks: DataFrame, block: int, sums: dict[str, Column]) -> DataFrame:
    """One row per distinct block behind a distinct prefix: its members, the smallest of them, and sums over them."""
    own = [f"{n}{i}" for i in range(1, block + 1) for n in "xyb"]
    # All members of a group agree in all of these.
    same = ["begin", "size", "px", "py", *own]
    return blocks.withColumns({f"end_{n}": c for n, c in zip(NODE, node_at(block))}).groupBy(*[f"end_{n}" for n in NODE]).agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), *[F.max(c).alias(c) for c in same], *[s.alias(n) for n, s in sums.items()],
    )


def turn_nodes(found: DataFrame, block: int, sums: dict[str, object]) -> DataFrame:
    """NODE, parent (its prefix digest), bytes, n, conv and sums: one row per node below the root, from distinct blocks.

    sums: name -> function of the bytes of a block's turns from some turn on, giving what the block adds to that turn's node.
    """
    parent = ["begin", "px", "py"]
    ends = [f"end_{n}" for n in NODE]
    alone = found.groupBy(*parent).agg(F.count("*").alias("c"), *[F.max(c).alias(c) for c in ends]).filter("c = 1").select(*ends, F.lit(True).alias("alone"))
    marked = found.join(alone, ends, "left")

    def nodes(i: int) -> Column:
        tail = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"b{k}"), F.lit(0).cast("bigint")) for k in range(i, block + 1)])
        above = node_at(block, i - 1)[1:] if i > 1 else [F.col("px").alias("x"), F.col("py").alias("y")]
        return F.struct(
            *node_at(block, i), F.struct(*above).alias("parent"), F.col(f"b{i}").alias("bytes"), "n", "conv", *[f(tail).alias(n) for n, f in sums.items()],
        )

    listed = F.inline_outer(F.slice(F.array(*[nodes(i) for i in range(1, block + 1)]), F.lit(1), F.col("size").cast("int")))
    no_sibling = marked.filter(F.col("alone").isNotNull()).select(listed)
    diverging = marked.filter(F.col("alone").isNull()).select(listed)
    refined = diverging.withColumns({"u": F.col("parent.x"), "v": F.col("parent.y")}).groupBy(*NODE).agg(
        F.max("u").alias("u"), F.max("v").alias("v"), F.max("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        *[F.sum(n).alias(n) for n in sums],
    )
    columns = [*NODE, F.struct(F.col("u").alias("x"), F.col("v").alias("y")).alias("parent"), "bytes", "n", "conv", *sums]
    return no_sibling.unionByName(refined.select(*columns))


def list_digests(members: DataFrame) -> DataFrame:
    """NODE, ends_sha256: the digest of each node's ids, ascending and comma-joined, from (NODE, conv).

    Ids are joined in pieces of a bounded range. SHA-256 has to see a node's pieces one after the other, so one task streams them; it
    never holds more than a piece.
    """
    piece = F.floor(F.col("conv") / LIST_RANGE)
    pieces = members.groupBy(*NODE, piece.alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select(*NODE, "piece", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    names = [*NODE, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for *key, _, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "piece", "ids")]):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, digest.hexdigest())], names)

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.mapInArrow(run, "depth bigint, x bigint, y bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    convs: conv, every conversation once, those without turns included. turns: conv, pos (from 1, gapless), digest, bytes. A node's
    text is that of turn ``depth`` of conversation ``conv_id``, its smallest member.
    """
    convs = stored(convs, "conversations")
    blocks = stored(block_rows(turns, block, secrets.randbits(62)), "prefixed-blocks", "zstd")
    found = stored(distinct_blocks(blocks, block, {}), "distinct-blocks", "zstd")
    nodes = stored(turn_nodes(found, block, {}), "nodes", "zstd")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent.x").alias("x"), F.col("parent.y").alias("y")).agg(F.count("*").alias("n_children"))
    children = stored(children, "children")
    # What each conversation owns: the nodes whose smallest member it is, and the leaf among them, if its path ends in one.
    owned = nodes.join(children, NODE, "left").groupBy("conv").agg(
        F.sum("bytes").alias("owned"), F.sum(F.col("n_children").isNull().cast("bigint")).alias("leaves"),
    )
    zero = F.lit(0).cast("bigint")
    held = blocks.join(stored(owned, "owned"), "conv", "left").fillna(0, ["owned", "leaves"])
    found = distinct_blocks(held, block, {
        "leaves": F.sum("leaves"), "after": F.sum("after"), "own_after": F.sum(F.least("after", "owned")),
        "own_here": F.sum(F.greatest(F.col("owned") - F.col("after"), zero)),
    })
    saved = lambda tail: F.col("after") - F.col("own_after") + F.col("n") * tail - F.least(tail, F.col("own_here"))
    summed = turn_nodes(stored(found, "summed-blocks", "zstd"), block, {"n_leaves": lambda tail: F.col("leaves"), "saved_tokens": saved})
    summed = stored(summed, "summed-nodes", "zstd")

    # The root is made from three totals, which are one row.
    every = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    below = summed.filter("depth = 1").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    own = [*NODE, "parent_conv_id", "n", "conv", "n_leaves", "saved_tokens"]
    long = lambda v: F.lit(v).cast("bigint")
    root = convs.sparkSession.range(1 if every["n"] else 0).select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), long(None).alias("parent_conv_id"), long(every["n"]).alias("n"), long(every["conv"]).alias("conv"),
        long(below["leaves"] or 1).alias("n_leaves"), long(below["saved"] or 0).alias("saved_tokens"),
    )
    first = summed.filter("depth = 1").withColumn("parent_conv_id", long(every["conv"])).select(*own)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.struct("x", "y").alias("parent"), F.col("conv").alias("parent_conv_id"))
    deep = summed.filter("depth > 1").join(above, ["depth", "parent"]).select(*own)

    ends = blocks.filter("last").select(*node_at(block), "conv")
    none = convs.join(blocks.filter("begin = 0").select("conv"), "conv", "left_anti")
    lists = list_digests(ends.unionByName(none.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv")))
    return (
        root.unionByName(first).unionByName(deep).join(children, NODE, "left").join(stored(lists, "list-digests"), NODE, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def trie_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of a table of turns as it stands."""
    rows = stored(turn_rows(conversations, conv, turn, role, text), "turn-rows", "zstd")
    return prefix_trie(rows.filter("pos = 1").select("conv"), rows, block)
