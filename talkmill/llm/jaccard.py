"""Exact similarity join on word n-grams: a size-aware join of small and large sets.

A document is the set of its 64-bit shingle hashes. Sets link when 100 * |A and B| >= similarity * |A or B|. Equal sets are
one node. Tokens have one global order, rare ones first; in it, two linked sets share one token among the first
n - ceil(t n) + 1 of each, and two among the first n - ceil(t n) + 2.

* Small sets enumerate the pairs of their first tokens (subsets of size two) and meet in the list of a pair.
* Large sets meet in the inverted lists of single tokens. Small sets near the boundary stand in those lists as well.
* The boundary is the size at which both ways together cost least, by the sizes of all sets and the mean length of lists.

The order comes from counts of all shingles of all documents, kept in a table of fixed size. Only the order depends on that
table, never the result, so its size bounds what is broadcast and nothing else.

Within a list, every member is first compared with the one whose list token stands earliest in its order; in a group of
copies that is the one all others were made from. Members that the first comparison put into one component need no further
one, and of all others each pair that can still reach the similarity, by its sizes and places in the order, is compared
exactly. So a group of n similar documents costs about n comparisons, and no link between different components is lost.

Null and empty texts have no shingles and link with nothing. Texts with fewer words than a shingle have one, the whole
sequence. Rows that repeat a key are documents of their own. Only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import forget, keep_possible, located, packed, settled, stored, without

WORDS, SIMILARITY = 5, 75
#: Counters of the frequency table: 2^24, one byte each after scaling.
TABLE_BITS, SLICES = 24, 512
#: Cost of a row that is shuffled to a list, in comparisons within a list.
ROW_COST = 30
#: Largest size that is considered as boundary; beyond it, pairs of first tokens always cost more.
LARGEST_BOUNDARY = 512
#: Partners that a document's text is moved to at once.
PARTNERS = 64
NODE = ["file", "row"]


def _mixers(words: int) -> list[np.uint64]:
    return [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(words + 1)]


class Shingler:
    """Sorted distinct shingle hashes of texts; A-Z are lower-cased, words are runs outside ASCII white space.

    All words of a text are hashed at once: random values of their bytes, times powers by place, are summed and mixed.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.mixers = words, _mixers(max(words, 5))
        self.white = np.zeros(256, dtype=bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)

    def _hashes(self, data: bytes) -> np.ndarray:
        signs = np.frombuffer(data, dtype=np.uint8)
        gap = self.white[signs]
        first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        sizes = np.flatnonzero(~gap & np.r_[gap[1:], True]) - first + 1
        at = np.flatnonzero(~gap)
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        if sizes.max() > len(self.powers):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * int(sizes.max()), self.mixers[0], dtype=np.uint64)])
        h = np.add.reduceat(self.values[signs[at]] * self.powers[at - np.repeat(first, sizes)], np.cumsum(sizes) - sizes)
        h += sizes.astype(np.uint64) * self.mixers[3]
        h = (h ^ (h >> np.uint64(32))) * self.mixers[2]
        return h ^ (h >> np.uint64(29))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self._hashes((text or "").encode().lower()) if text else np.zeros(0, dtype=np.uint64)
        if not len(h):
            return h
        size = min(self.words, len(h))
        n = len(h) - size + 1
        s = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            s = (s ^ h[i:i + n]) * self.mixers[i]
            s ^= s >> np.uint64(29)
        s *= self.mixers[-1]
        s ^= s >> np.uint64(32)
        return np.unique(s)


def needed(n: int, similarity: int = SIMILARITY) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-similarity * n // 100)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = _mixers(3)
    s = (a ^ np.uint64(2)) * m[0]
    s = ((s ^ (s >> np.uint64(31))) + b) * m[1]
    return (s ^ (s >> np.uint64(32))) * m[2]


def list_keys(tokens: np.ndarray, levels: np.ndarray, boundary: int, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists that a set stands in, and the place in the order that bounds what it can share in each.

    With place q, the set shares at most n - q tokens with a set that it meets first in this list.
    """
    n = len(tokens)
    spare = n - needed(n, similarity)
    if spare == 0 and n < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    rank = (levels[tokens >> np.uint64(64 - TABLE_BITS)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    first = tokens[np.argsort(rank, kind="stable")[:spare + 2]]
    keys, places = [], []
    if n < boundary:
        i, j = np.triu_indices(len(first), 1)
        keys.append(pair_hash(first[i], first[j]))
        places.append(j - 1)
    if n >= needed(boundary, similarity):
        keys.append(first[:spare + 1])
        places.append(np.arange(min(len(first), spare + 1)))
    return np.concatenate(keys), np.concatenate(places).astype(np.int32)


def first_pass(docs: DataFrame, words: int) -> DataFrame:
    """One pass over all texts. Rows with ``fp``: key, file, row, n, fp (128 bits of the whole set) of each document. Rows with
    ``slice``: a task's counts of the shingles of its documents, cut into slices of the frequency table."""
    width = (1 << TABLE_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, table, names = Shingler(words), np.zeros(1 << TABLE_BITS, dtype=np.uint32), ["key", *NODE, "n", "fp", "slice", "counts"]
        kinds = None
        for batch in batches:
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            for s in sets:
                np.add.at(table, (s >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
            fp = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            kept = batch.select(["key", *NODE])
            kinds = kept.schema.types
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([len(s) for s in sets], pa.int64()), fp, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
        if kinds and table.any():
            parts = [pack_counts(table[i * width:(i + 1) * width]) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(SLICES, k) for k in kinds], pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()),
                 pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names,
            )

    # All columns may be null: documents have no slice, and slices no document.
    fields = [*docs.select("key", *NODE).schema.fields, *T.StructType.fromDDL("n bigint, fp binary, slice int, counts binary").fields]
    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte per counter, then places and counts of those that need more, all compressed: a task's counters are mostly small or none."""
    large = np.flatnonzero(counts >= 255)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u4").tobytes() + counts[large].astype("<u4").tobytes(), 1)


def unpack_counts(packed: bytes, width: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    counts = np.frombuffer(raw, dtype=np.uint8, count=width).astype(np.uint64)
    places, large = np.frombuffer(raw, dtype="<u4", offset=width).reshape(2, -1)
    counts[places] = large
    return counts


def frequency_levels(slices: DataFrame) -> tuple[np.ndarray, float]:
    """A byte per counter that grows with the logarithm of the shingles counted in it, and the mean number of other sets in the
    list of a shingle. Slices of all tasks are added as they arrive; the whole table, 16 MB, goes to the driver."""
    width = (1 << TABLE_BITS) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + unpack_counts(raw, width)
        levels = [np.minimum(255, 4 * np.log2(1 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        squares = [float(np.sum(s.astype(float) ** 2)) for s in sums.values()]
        totals = [float(np.sum(s)) for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary()), pa.array(squares, pa.float64()), pa.array(totals, pa.float64())],
            ["slice", "levels", "squares", "total"],
        )

    added = slices.select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, levels binary, squares double, total double")
    levels = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    squares = total = 0.0
    for r in added.collect():
        levels[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["levels"], dtype=np.uint8)
        squares, total = squares + r["squares"], total + r["total"]
    # What other shingles in the same counter add on average is taken off.
    return levels, max(0.0, squares / total - 1 - total / len(levels)) if total else 0.0


def choose_boundary(sizes: dict[int, int], others: float, similarity: int = SIMILARITY) -> int:
    """The boundary at which small and large sets together cost least.

    sizes: how many sets there are of each size below LARGEST_BOUNDARY; larger ones cost the same with any boundary.
    """
    small, large = {}, {}
    for n, count in sizes.items():
        spare = n - needed(n, similarity)
        if spare == 0 and n < 3:  # these link with their equals only, and stand in no list
            continue
        small[n] = count * (spare + 2) * (spare + 1) / 2 * ROW_COST
        large[n] = count * (spare + 1) * (ROW_COST + others)
    best, least = 0, None
    for b in range(0, LARGEST_BOUNDARY + 1):
        cost = sum(c for n, c in small.items() if n < b) + sum(c for n, c in large.items() if n >= needed(b, similarity))
        if least is None or cost < least:
            best, least = b, cost
    return best


def postings(docs: DataFrame, levels: np.ndarray, boundary: int, words: int, similarity: int) -> DataFrame:
    """list, id, fit (size * 2^32 + place): the lists each document (id, text) stands in."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                keys, fits = [], []
                for text in part.column("text").to_pylist():
                    s = shingler(text)
                    k, p = list_keys(s, sent.value, boundary, similarity) if len(s) else (s, np.zeros(0, dtype=np.int32))
                    keys.append(k)
                    fits.append((np.int64(len(s)) << 32) + p)
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), part.column("id").take(row), pa.array(np.concatenate(fits))], ["list", "id", "fit"]
                )

    return docs.select("id", "text").mapInArrow(run, "list bigint, id bigint, fit bigint")


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets link, either way round. Only the texts of their documents are moved: of a pair, that of the
    document with more partners once for every PARTNERS of them, the other's once a pair. They are made into sets again where
    they meet, one at a time."""
    partners = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("c"))
    partners = stored(partners, "partners")
    known = pairs.join(partners.select(F.col("id").alias("a"), F.col("c").alias("ac")), "a").join(partners.select(F.col("id").alias("b"), F.col("c").alias("bc")), "b")
    turned = F.col("ac") < F.col("bc")
    first, other = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    cut = known.select(first.alias("a"), other.alias("b"), F.pmod(F.xxhash64(other), F.ceil(F.greatest("ac", "bc") / PARTNERS)).alias("slice"))
    cut = stored(cut, "cut-pairs")
    firsts = cut.select("a", "slice").distinct().select("a", "slice", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("id"))
    asked = stored(firsts.unionByName(cut.withColumn("id", F.col("b"))), "asked")
    texts = keep_possible(rows.select("id", "text"), F.col("id"), asked, F.col("id")).join(asked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at, first = Shingler(words), None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for part in (batch.slice(lo, 500) for lo in range(0, batch.num_rows, 500)):
                linked = []
                for a, cut_at, b, text in zip(*[part.column(c).to_pylist() for c in ("a", "slice", "b", "text")]):
                    own = shingler(text)
                    if b is None:
                        at, first = (a, cut_at), own
                        continue
                    assert at == (a, cut_at), "a partner without its first"
                    both = len(np.intersect1d(first, own, assume_unique=True))
                    if 100 * both >= similarity * (len(first) + len(own) - both):
                        linked.append((a, b))
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked)], ["a", "b"])

    together = texts.select("a", "slice", "b", "text").repartition("a", "slice")
    return together.sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable from every id in the edges (a, b), by alternating large and small stars."""
    edges = stored(edges.filter("a != b").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            floor.select("a", F.col("m").alias("b"))
        ).filter("a != b").distinct()
        edges = stored(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    tops = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return tops.unionByName(edges.select("b").distinct().join(tops.select(F.col("id").alias("b")), "b", "left_anti").select(
        F.col("b").alias("id"), F.col("b").alias("component")))


def link_nodes(lists: DataFrame, rows: DataFrame, words: int, similarity: int) -> DataFrame:
    """id, component of the nodes in lists (list, id, n, place) that link with another."""
    fits = lambda a, b: (  # noqa: E731  the most that both can share reaches the similarity
        (100 + similarity) * F.least(F.col(f"{a}n") - F.col(f"{a}place"), F.col(f"{b}n") - F.col(f"{b}place"))
        >= similarity * (F.col(f"{a}n") + F.col(f"{b}n"))
    )
    named = lambda df, p: df.select("list", *[F.col(c).alias(f"{p}{c}") for c in df.columns if c != "list"])
    pair = [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")]
    heads = lists.groupBy("list").agg(F.min(F.struct("place", "n", "id")).alias("h")).select("list", "h.*")
    first = named(lists, "x_").join(named(heads, "y_"), "list").filter((F.col("x_id") != F.col("y_id")) & fits("x_", "y_"))
    tested = stored(first.select(*pair).distinct(), "first-pairs")
    edges = stored(verified(tested, rows, words, similarity), "first-links")
    found = stored(components(edges), "first-components")
    placed = stored(lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    open_lists = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("list")
    rest = stored(placed.join(open_lists, "list", "left_semi"), "open-lists")
    cross = named(rest, "x_").join(named(rest, "y_"), "list").filter(
        (F.col("x_id") < F.col("y_id")) & (F.col("x_component") != F.col("y_component")) & fits("x_", "y_")
    )
    untested = stored(cross.select(*pair).distinct().join(tested, ["a", "b"], "left_anti"), "more-pairs")
    more = stored(verified(untested, rows, words, similarity), "more-links")
    return components(edges.unionByName(more))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY,
) -> DataFrame:
    """key, n_shingles, component_id (smallest key that links reach), file, row: one row per document."""
    rows = located(docs.select(key, text)).select(
        F.col(key).alias("key"), F.col("__file").alias("file"), F.col("__row").alias("row"), F.col(text).cast("string").alias("text")
    )
    passed = stored(first_pass(rows, words), "first-pass", "zstd")
    prints = stored(passed.filter("fp IS NOT NULL").drop("slice", "counts"), "prints", "zstd")
    levels, others = frequency_levels(passed.filter("slice IS NOT NULL"))
    forget(passed)
    # A document's id is its file's number and its row. There are as many numbers as files, which the driver lists anyway.
    files = stored(prints.select("file").distinct().withColumn("no", F.row_number().over(Window.orderBy("file")).cast("bigint")), "files")
    numbered = lambda df: df.join(F.broadcast(files), "file").withColumn("id", F.shiftleft("no", 40) + F.col("row")).drop("no")
    whole = numbered(prints.filter("n > 0"))
    same = stored(
        whole.groupBy("fp").agg(F.min("id").alias("id"), F.min("key").alias("least"), F.count("*").alias("size"), F.first("n").alias("n")),
        "sets", "zstd",
    )
    copies = whole.join(same.filter("size > 1").select("fp", F.col("id").alias("first")), "fp").filter(F.col("id") != F.col("first")).select("id")
    placed = numbered(rows)
    single = without(placed, ["id"], stored(copies, "copies"))
    sizes = {r["n"]: r["c"] for r in same.filter(F.col("n") < LARGEST_BOUNDARY).groupBy("n").agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary(sizes, others, similarity)
    # Only lists of two or more matter. A list is counted in every task before it is counted as a whole.
    every = stored(postings(single, levels, boundary, words, similarity), "postings", "zstd")
    shared = stored(every.groupBy("list").agg(F.count("*").alias("c")).filter("c > 1").select("list"), "shared-lists")
    fit = F.col("fit")
    lists = every.join(shared, "list", "left_semi").select(
        "list", "id", F.shiftright(fit, 32).cast("int").alias("n"), fit.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place")
    )
    lists = stored(lists, "lists")
    forget(every, shared)
    linked = settled(docs.sparkSession, lambda: link_nodes(lists, placed, words, similarity), "components")
    forget(lists)
    # Every set's smallest key, then every component's, which then goes to the documents of all its sets.
    member = linked.join(same, "id")
    tops = member.groupBy("component").agg(F.min("least").alias("top"))
    by_set = member.join(tops, "component").select("fp", "top")
    alone = same.filter("size > 1").join(by_set.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("top"))
    tops = stored(by_set.unionByName(alone), "tops")
    return prints.join(tops, "fp", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("top").isNotNull(), F.col("top")).otherwise(F.col("key")).alias("component_id"), *NODE,
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay when one of each component does: the one with the smallest key, of equal keys the first stored."""
    rows = packed(docs)
    judged = rows.select(F.col("__doc")[key].alias("key"), F.col("__doc")[text].alias("text"))
    found = settled(docs.sparkSession, lambda: near_duplicates(judged, "key", "text"), "near-duplicates")
    first = found.groupBy("component_id").agg(F.min(F.struct("key", *NODE)).alias("first"), F.count("*").alias("c"), F.max("n_shingles").alias("m"))
    stay = first.filter("c > 1 AND m > 0").select("component_id", "first")
    gone = found.filter("n_shingles > 0").join(stay, "component_id").filter(F.struct("key", *NODE) != F.col("first"))
    gone = stored(gone.select(F.col("file").alias("__file"), F.col("row").alias("__row")), "gone")
    forget(found)
    return without(rows, ["__file", "__row"], gone).select("__doc.*")
