"""Divergence of sources from each other and from their language, by a cube of tasks.

Every source of a language is a group with a distribution over the language's terms: those found in at least ``least_docs`` of its
documents. Probabilities are whole numbers in units of 1 / SCALE, smoothed by one occurrence a term, and all arithmetic is exact.

The divergence of all pairs of groups is a cube: group by group by term. Groups are cut into blocks of at most GROUP_BLOCK, and
terms by a hash into blocks of about TERM_BLOCK. The counts of a group block in a term block are one slice. A slice is replicated to
each cell (group block, group block, term block) that needs it; a cell holds two slices at most, whatever the input's size, computes
the part that its terms add to each of its pairs, both ways, and the parts are summed along the term axis.

Counting is one pass: a task adds up its documents by (language, source, term) and hands on what it has whenever that is
COUNT_ROWS entries, so that a source with a third of all documents, or a word in all of them, costs each task a row. Groups are numbered
by range partitions, and ranks come from windows over one group, the best ``top`` terms cut in each task before the shuffle.

Null text, language or source is the empty string, a value like any other. A document without terms still makes its group occur; a
language without kept terms has divergences of 0 and no rows of terms. Repeated rows are documents of their own. An empty
table gives no rows. Only the three columns are read, so others may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import positions, stored, text_or_empty

SCALE = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
#: A slice has at most GROUP_BLOCK groups and about TERM_BLOCK terms; in a cell that is 2 MB a slice.
GROUP_BLOCK, TERM_BLOCK = 32, 8192
#: Entries that a counting task holds before it hands them on.
COUNT_ROWS = 400_000
#: Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are lower-cased.
_LETTERS = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split(b" ")


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: parts of the counts, one row per task and key or a few, from lang, source, text."""

    def handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        keys = [(lang, source, len(n)) for (lang, source), (n, _) in held.items()]
        sizes = [size for *_, size in keys]
        spread = lambda values: pa.array(values, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
        terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
        occurrences = pa.array([c for n, _ in held.values() for c in n.values()], pa.int64())
        found_in = pa.array([d[t] for n, d in held.values() for t in n], pa.int64())
        return pa.RecordBatch.from_arrays(
            [spread([k[0] for k in keys]), spread([k[1] for k in keys]), terms, occurrences, found_in], ["lang", "source", "term", "n", "docs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for part in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            for lang, source, text in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "text")]):
                own = Counter(terms_of(text))
                del own[b""]
                n, found_in = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(own)
                found_in.update(own.keys())
            if sum(len(n) for n, _ in held.values()) > COUNT_ROWS:
                yield handed_on(held)
                held = {}
        if held:
            yield handed_on(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1)
    return F.lit(1) + F.call_function("div", scaled, wide(total + terms)).cast("bigint")


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same of a matrix of counts, a row per group. Python's integers take over where 64 bits would not do."""
    whole = counts if counts.max(initial=0) < (1 << 63) // SCALE - 1 else counts.astype(object)
    return (1 + SCALE * (whole + 1) // (totals + terms)[:, None]).astype(np.int64)


def cell_parts(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums over the terms of floor((p - q)^2 / q), for p of every row and q of every column."""
    parts = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, p in enumerate(rows):
        for j, q in enumerate(columns):
            apart = p - q
            parts[i, j] = (apart * apart // q).sum()
    return parts


def compute_cell(cell: pa.Table) -> pa.Table:
    """lang, source, item, part: what a cell's terms add to its pairs of different groups."""
    blocks = []
    for slice_, entries in zip(cell.drop_columns(["entries"]).to_pylist(), cell.column("entries")):
        counts = np.zeros((len(slice_["groups"]), slice_["terms_here"]), dtype=np.int64)
        if entries.is_valid:
            g, t, n = (entries.values.field(c).to_numpy() for c in ("g", "t", "n"))
            counts[g, t] = n
        members = sorted(slice_["groups"], key=lambda m: m["g"])
        totals = np.array([m["total"] for m in members], dtype=np.int64)
        blocks.append(([m["source"] for m in members], shares(counts, totals, slice_["terms"]), slice_["lang"]))
    found: list[tuple[str, str, str, int]] = []
    for names, p, lang in blocks:
        for others, q, _ in blocks:
            if len(blocks) > 1 and others is names:
                continue
            parts = cell_parts(p, q)
            found += [(lang, a, b, int(parts[i, j])) for i, a in enumerate(names) for j, b in enumerate(others) if a != b]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 4, kinds)], ["lang", "source", "item", "part"])


def pair_parts(counts: DataFrame, groups: DataFrame, blocks: DataFrame, group_block: int) -> DataFrame:
    """lang, source, item, value: the divergence of every pair of groups of a language.

    counts: lang, source, block, t (number in the block), n. groups: lang, source, number, total, terms, members (groups of the
    language). blocks: lang, block, terms_here.
    """
    placed = groups.withColumn("gb", F.floor(F.col("number") / group_block)).withColumn("g", (F.col("number") % group_block).cast("int"))
    entries = counts.join(placed.select("lang", "source", "gb", "g"), ["lang", "source"])
    slices = entries.groupBy("lang", "gb", "block").agg(F.collect_list(F.struct("g", "t", "n")).alias("entries"))
    # Every group block meets every term block, whether or not a term of the block is in it.
    headers = placed.groupBy("lang", "gb").agg(
        F.collect_list(F.struct("g", "source", "total")).alias("groups"), F.max("terms").alias("terms"), F.max("members").alias("members"),
    )
    last = F.floor((F.col("members") - 1) / group_block)
    cells = (
        headers.join(blocks, "lang").join(slices, ["lang", "gb", "block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("lo", F.least("gb", "other")).withColumn("hi", F.greatest("gb", "other"))
    )
    parts = cells.groupBy("lang", "lo", "hi", "block").applyInArrow(compute_cell, "lang string, source string, item string, part bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: all other sources of the language by their divergence from the source.
    Part ``term``: the ``top`` terms that the source has in excess of its language, by what they add to the divergence from it."""
    rows = docs.select(*[text_or_empty(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = stored(
        count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts", "zstd"
    )
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
    kept = stored(kept.drop("docs"), "kept-terms", "zstd")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    every = stored(rows.select("lang", "source").distinct(), "groups")
    # A language without a kept term still has one block, an empty one.
    sized = every.groupBy("lang").agg(F.count("*").alias("members")).join(langs, "lang", "left").fillna(0, ["terms", "lang_total"])
    sized = stored(sized.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block))), "languages")
    block = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    in_block = Window.partitionBy("lang", "block").orderBy("term")
    terms = kept.join(sized, "lang").withColumn("block", block).withColumn("t", F.row_number().over(in_block).cast("int") - 1)
    terms = stored(terms.select("lang", "term", "block", "t", "lang_n", "lang_total", "terms"), "terms", "zstd")
    found = stored(counts.drop("docs").join(terms, ["lang", "term"]), "kept-counts", "zstd")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = positions(every, ["lang"], [F.col("source")], "number").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = stored(numbered.join(sized.select("lang", "members", "terms"), "lang"), "numbered-groups")

    filled = terms.groupBy("lang", "block").agg(F.count("*").cast("int").alias("terms_here"))
    blocks = sized.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)).alias("block"))
    blocks = blocks.join(filled, ["lang", "block"], "left").fillna(0, ["terms_here"])
    pairs = pair_parts(found.select("lang", "source", "block", "t", "n"), groups, blocks, group_block)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    own = found.join(groups.select("lang", "source", "total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    ).filter("p > q")
    apart = F.col("p") - F.col("q")
    over = own.select("lang", "source", "item", F.call_function("div", apart * apart, F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
