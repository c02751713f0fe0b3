"""Vectors on chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.embedding import EmbeddingProvider, hash_provider, parse_vector
from talkmill.functions.numeric import cosine
from talkmill.session import cut_lineage

#: Vectors that are packed into one row, asking and asked; a cell holds one block of each and their products, 1024 asked ones at a time.
ASKING_BLOCK, ASKED_BLOCK, PRODUCT_ROWS = 4096, 8192, 1024
#: How far two ways of summing the same products can differ; whatever is this near to the k-th place is computed again, exactly alike.
_NEAR = 1e-9


def _checked(vector: Column, provider: EmbeddingProvider) -> Column:
    """The vector, or an error that stops the job when its length is wrong."""
    wrong = F.raise_error(F.lit(f"embedding dimension mismatch: expected {provider.dimension}")).cast("array<double>")
    return F.when(vector.isNull() | (F.size(vector) == provider.dimension), vector).otherwise(wrong)


def with_embeddings(chunks: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
    provider = provider or hash_provider()
    embedded = chunks.withColumn("embedding", provider.embed(F.col("text")))
    return embedded.withColumn("embedding", _checked(F.col("embedding"), provider))


def backfill_embeddings(chunks: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
    """Fill missing vectors in one pass; rows that have one send only a null to the provider."""
    provider = provider or hash_provider()
    missing = F.when(F.col("embedding").isNull(), F.col("text"))
    filled = chunks.withColumn("_new", provider.embed(missing))
    return filled.withColumn("embedding", F.coalesce("embedding", _checked(F.col("_new"), provider))).drop("_new")


def load_vectors(chunks: DataFrame, column: str = "embedding_vector") -> DataFrame:
    """Turn vectors stored as JSON text into arrays."""
    return chunks.withColumn("embedding", parse_vector(F.col(column))).drop(column)


def cosine_topk(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """The k rows nearest to one query vector: a scan and a top-k, no join.

    ``vectors`` has id and embedding; ``query`` is a literal or a scalar subquery.
    """
    scored = vectors.select("id", "embedding", query.alias("q"))
    return (
        scored.select("id", cosine(F.col("embedding").cast("array<double>"), F.col("q").cast("array<double>")).alias("cosine"))
        .orderBy(F.desc("cosine"), "id")
        .limit(k)
    )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """ids, values, sizes: up to ``size`` rows (id, embedding) of a partition in one; a null vector has no values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            vectors = table.column("embedding").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
            lengths = vectors.value_lengths().fill_null(0).to_pylist()
            return pa.RecordBatch.from_arrays(
                [pa.array([table.column("id").to_pylist()], pa.list_(pa.string())), pa.array([vectors.flatten().to_numpy()], pa.list_(pa.float64())),
                 pa.array([lengths], pa.list_(pa.int32()))], ["ids", "values", "sizes"],
            )

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, size - n)
                held, n, batch = [*held, taken], n + taken.num_rows, batch.slice(taken.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    plain = rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(run, "ids array<string>, values array<double>, sizes array<int>")


def _units(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of length one; zero rows for vectors of another length, or of none."""
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    same = np.flatnonzero(sizes == width)
    if width and len(same):
        out[same] = values[starts[same][:, None] + np.arange(width)]
    norms = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norms > 0, norms, 1)[:, None]


class _Best:
    """The k best ids of every asking vector of a block, as asked blocks go by."""

    def __init__(self, ids: list[str], values: np.ndarray, sizes: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.by_width = [(int(w), at, _units(values, sizes, int(w))[at]) for w in np.unique(sizes) for at in [np.flatnonzero(sizes == w)]]
        self.found: list[list[tuple[float, str]]] = [[] for _ in ids]

    def add(self, ids: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        for width, at, asking in self.by_width:
            asked = _units(values, sizes, width)
            for lo in range(0, len(ids), PRODUCT_ROWS):
                part = asked[lo:lo + PRODUCT_ROWS]
                products = asking @ part.T if width else np.zeros((len(at), len(part)))
                for row, q in enumerate(at):
                    held = self.found[q]
                    least = held[-1][0] if len(held) == self.k else -2.0
                    line = products[row]
                    if len(line) > self.k:
                        least = max(least, np.partition(line, len(line) - self.k)[len(line) - self.k])
                    near = np.flatnonzero(line >= least - _NEAR)
                    if len(near):
                        exact = (part[near] * asking[row]).sum(axis=1) if width else np.zeros(len(near))
                        merged = held + [(float(c), ids[lo + i]) for c, i in zip(exact, near)]
                        self.found[q] = sorted(merged, key=lambda x: (-x[0], x[1]))[:self.k]

    def rows(self) -> pa.RecordBatch:
        every = [(q, i, c) for q, best in zip(self.ids, self.found) for c, i in best]
        kinds = [pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*every) if every else [()] * 3, kinds)], ["query_id", "id", "cosine"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, lanes: int | None = None) -> DataFrame:
    """query_id, id, cosine, position: the k rows of ``vectors`` nearest to each row of ``queries``, ties by id; both have id, embedding.

    Vectors are packed in blocks. Every asked block goes to one lane of each asking block; a lane takes matrix products and keeps the k
    best per asking vector, so what leaves it is k rows a query, never pairs. Null vectors and those of another length or of none are
    at cosine 0. Query ids are distinct.
    """
    spark = vectors.sparkSession
    asking = cut_lineage(_packed(queries, ASKING_BLOCK).withColumn("block", F.monotonically_increasing_id()))
    blocks = [r["block"] for r in asking.select("block").collect()]  # a number for every ASKING_BLOCK queries
    lanes = lanes or max(1, 2 * spark.sparkContext.defaultParallelism // max(1, len(blocks)))
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    every_block = F.explode(F.array(*[F.lit(b).cast("bigint") for b in blocks]).cast("array<bigint>"))
    one = asking.select("block", every_lane.alias("lane"), F.lit(0).alias("side"), "ids", "values", "sizes")
    asked = _packed(vectors, ASKED_BLOCK)
    other = asked.select(
        every_block.alias("block"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("side"), "ids", "values", "sizes"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: _Best | None = None
        for batch in batches:
            sides = batch.column("side").to_pylist()
            for i, side in enumerate(sides):
                ids, values, sizes = (batch.column(c)[i] for c in ("ids", "values", "sizes"))
                block = ids.as_py(), values.values.to_numpy(), sizes.values.to_numpy()
                if side == 0:
                    if best is not None:
                        yield best.rows()
                    best = _Best(*block, k)
                else:
                    best.add(*block)
        if best is not None:
            yield best.rows()

    cells = one.unionByName(other).repartition("block", "lane").sortWithinPartitions("block", "lane", "side")
    found = cells.mapInArrow(run, "query_id string, id string, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
