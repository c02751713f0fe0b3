"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Each window takes from every queue its share of the window; what a share
cannot give in whole tokens is the queue's deficit and is carried to the next window. Deficits are never stored: with shares
in units of 2^-20, the tokens a queue has given after k windows are (k * upper >> 10) - (k * lower >> 10), where upper and
lower bound its share of the unit interval. The sum over all queues is exactly 1024 * k, and any task can continue at any
window, so the deficits also carry across partitions. When a queue cannot fill its share any more, the next phase deals
its share to the others; what is left at the end is packed in a row, the last tokens as sequences of powers of two.

Sources of ``targets`` have a queue each. Of the others, those with less than 1/1024 of all tokens share one queue, so besides
the targets there are at most 1,025 queues at any size, and only their totals reach the driver. In the shared queue every source
is dealt out in runs of at most RUN tokens, spread evenly over the whole queue, so each stretch of it has their proportions.
A source may hold any part of all rows: its place in the queue comes from counts per file. Targets that cannot be met in any
window are refused: those of sources without tokens, and those below a token per window.

A null or empty text has the end token only; a null source counts as the source "null". Repeated rows are packed each. Only the key, the
source and the text are read. A text of any length is cut wherever windows end; each token lies in exactly one piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm import bpe
from talkmill.llm.common import stored

WINDOW = 1024
END = 0
UNITS = 1 << 20
#: Smallest share of a queue of its own: a token per window, below which its count could not grow steadily.
LEAST = UNITS // WINDOW
POOL = "pool"
#: Tokens of a run of the shared queue, and tokens of it whose runs are put in order together.
RUN, STRETCH = 64, 1 << 20


@dataclass(frozen=True)
class Share:
    """A queue's part in a phase: tokens from ``begin`` to ``end`` of the queue go to ``windows`` windows from ``first`` on."""

    first: int
    windows: int
    begin: int
    end: int
    lower: int
    upper: int

    def given(self, k):
        """Tokens given after k windows of the phase."""
        return (k * self.upper >> 10) - (k * self.lower >> 10)


@dataclass(frozen=True)
class Tail:
    """Tokens from ``begin`` to ``end`` of the queue stand at ``at`` in the row that follows the last phase."""

    begin: int
    end: int
    at: int


@dataclass(frozen=True)
class Schedule:
    shares: dict[str, list[Share]]
    tails: dict[str, Tail]
    windows: int
    tail_tokens: int


def units(weights: dict[str, float]) -> dict[str, int]:
    """Whole units that sum to UNITS; queues below the least share are left out, but not the shared one, which then comes first."""
    total = sum(weights.values())
    kept = {q: w for q, w in weights.items() if w * UNITS >= LEAST * total or q == POOL}
    total = sum(kept.values())
    got = {q: max(LEAST, int(w * UNITS / total)) if q != POOL else int(w * UNITS / total) + 1 for q, w in sorted(kept.items(), key=lambda x: x[0] != POOL)}
    if got:
        got[max(got, key=got.get)] += UNITS - sum(got.values())
    return got


def plan(totals: dict[str, int], targets: dict[str, float] | None = None) -> Schedule:
    """Phases for queues with the given tokens. Without targets, every window has the proportions of the corpus."""
    left = dict(sorted(totals.items()))
    taken = dict.fromkeys(left, 0)
    shares: dict[str, list[Share]] = {q: [] for q in left}
    window = 0
    while True:
        active = {q: (float(n) if targets is None else targets.get(q, 0.0)) for q, n in left.items() if n}
        dealt = units({q: w for q, w in active.items() if w > 0})
        steps, lower = [], 0
        for q, u in dealt.items():
            steps.append((q, lower, lower + u))
            lower += u
        given = lambda k, lo, hi: (k * hi >> 10) - (k * lo >> 10)
        n = min([(left[q] + 1) * 1024 // (hi - lo) + 1 for q, lo, hi in steps], default=0)
        while n and any(given(n, lo, hi) > left[q] for q, lo, hi in steps):
            n -= 1
        if not n:
            # A target queue that is nearly empty leaves the round; its rest is packed at the end.
            if targets is not None and steps:
                short = {q for q, lo, hi in steps if given(1, lo, hi) > left[q]}
                rest = {q: w for q, w in targets.items() if q not in short}
                if short and any(left.get(q) for q in rest):
                    targets = rest
                    continue
            break
        for q, lo, hi in steps:
            tokens = given(n, lo, hi)
            shares[q].append(Share(window, n, taken[q], taken[q] + tokens, lo, hi))
            taken[q] += tokens
            left[q] -= tokens
        window += n
    tails, at = {}, 0
    for q, n in left.items():
        tails[q] = Tail(taken[q], taken[q] + n, at)
        at += n
    return Schedule(shares, tails, window, at)


def cut(schedule: Schedule, queue: str, begin: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens from ``begin`` on of a queue go: starts of the pieces, their sequences and their offsets there."""
    starts, sequences, offsets = [], [], []
    end = begin + size
    for s in schedule.shares[queue]:
        a, b = max(begin, s.begin), min(end, s.end)
        if a >= b:
            continue
        near = lambda x: (x << 10) // (s.upper - s.lower)
        k = np.arange(max(0, near(a - s.begin) - 2), min(s.windows, near(b - s.begin) + 3), dtype=np.int64)
        from_, to = s.begin + s.given(k), s.begin + s.given(k + 1)
        k, from_ = k[(to > a) & (from_ < b) & (to > from_)], from_[(to > a) & (from_ < b) & (to > from_)]
        first = np.maximum(from_, a)
        starts.append(first - begin)
        sequences.append(s.first + k)
        offsets.append((((k + 1) * s.lower) >> 10) - ((k * s.lower) >> 10) + first - from_)
    t = schedule.tails[queue]
    a, b = max(begin, t.begin), min(end, t.end)
    if a < b:
        bounds = tail_bounds(schedule.tail_tokens)
        x, y = t.at + a - t.begin, t.at + b - t.begin
        n = np.arange(np.searchsorted(bounds, x, "right") - 1, np.searchsorted(bounds, y, "left"), dtype=np.int64)
        first = np.maximum(bounds[n], x)
        starts.append(first - t.at + t.begin - begin)
        sequences.append(schedule.windows + n)
        offsets.append(first - bounds[n])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return join(starts), join(sequences), join(offsets)


def tail_bounds(tokens: int) -> np.ndarray:
    """Bounds of the last sequences: full windows, then one for each power of two in the rest."""
    bounds = list(range(0, tokens - tokens % WINDOW + 1, WINDOW))
    rest = tokens % WINDOW
    for power in (1 << p for p in range(9, -1, -1)):
        if rest & power:
            bounds.append(bounds[-1] + power)
    return np.array(bounds, dtype=np.int64)


def id_type(vocabulary: str) -> str:
    """Type that tokens are stored in: 16-bit integers where the vocabulary's ids fit, else 32-bit ones."""
    spec = json.loads(vocabulary)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]
    return "<u2" if max(ids, default=0) <= 0xFFFF else "<u4"


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, key, source, before, doc_tokens, ids: the tokens of every document with the end token, as integers of ``id_type``.

    ``part`` numbers the task and ``before`` counts the tokens of the same source that stand earlier in it.
    """
    source_text = bpe.read_vocabulary(path)
    kind = np.dtype(id_type(source_text))
    vocabulary = docs.sparkSession.sparkContext.broadcast(source_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec(vocabulary.value)
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sources = batch.column("source").to_pylist()
            for a, b in bpe.chunks(texts):
                ids, counts = codec.encode(texts[a:b])
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype(kind), ends, END)
                counts = counts + 1
                before = []
                for s, n in zip(sources[a:b], counts.tolist()):
                    before.append(met.get(s, 0))
                    met[s] = met.get(s, 0) + n
                stops = np.r_[0, np.cumsum(counts)] * kind.itemsize
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (b - a), pa.int64()), batch.column("key").slice(a, b - a), batch.column("source").slice(a, b - a),
                     pa.array(before, pa.int64()), pa.array(counts), pa.array([raw[x:y] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())], pa.binary())],
                    ["part", "key", "source", "before", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("null")).alias("source"), F.col(text).cast("string").alias("text"))
    zero = F.lit(0).cast("bigint")
    schema = rows.select(zero.alias("part"), "key", "source", zero.alias("before"), zero.alias("doc_tokens"), F.lit(b"").alias("ids")).schema
    return rows.mapInArrow(run, schema)


def pool_runs(counts: DataFrame, whole: int) -> DataFrame:
    """source, run, run_at: where each run of the shared queue's sources begins in it. ``counts`` has n, the tokens of a source.

    Runs of a source lie evenly between 0 and 1, from a place given by its hash; stretches of that line are summed apart."""
    stretches = whole // STRETCH + 1
    runs = counts.withColumn("runs", F.ceil(F.col("n") / RUN)).select("source", "n", "runs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("runs") - 1)).alias("run"))
    place = (F.col("run") + F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)) / F.col("runs")
    runs = runs.select("source", "run", place.alias("place"), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).alias("size")).withColumn("stretch", F.floor(F.col("place") * stretches))
    ordered = Window.partitionBy("stretch").orderBy("place", "source").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("stretch").agg(F.sum("size").alias("n"))  # a row for each STRETCH tokens
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("stretch_at"))
    inside = runs.withColumn("inside", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    return inside.join(totals, "stretch").select("source", "run", (F.col("stretch_at") + F.col("inside")).alias("run_at"))


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None,
) -> DataFrame:
    """key, start, length, ids, doc_tokens, sequence_id, offset: the pieces, with their ids as little-endian 32-bit integers.

    ``targets`` gives the wanted proportion of each source in a window; sources it leaves out come at the end.
    """
    kind = np.dtype(id_type(bpe.read_vocabulary(path)))
    width = kind.itemsize
    tokens = stored(tokenized(docs, path, key, text, source), "tokens", "zstd")
    per_file = stored(tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "token-counts")
    per_source = per_file.groupBy("source").agg(F.sum("n").alias("n"))
    whole = per_source.agg(F.sum("n")).first()[0] or 0
    # At most 1,024 rows, and one for each target.
    own = per_source.filter((F.col("n") * WINDOW >= F.lit(whole)) | F.col("source").isin(sorted(targets or {})))
    named = {r["source"]: r["n"] for r in own.collect()}
    if targets and whole:
        least = sum(targets.values()) / WINDOW
        for s, w in targets.items():
            if w and (s not in named or not w >= least):
                raise ValueError(f"target of source {s!r} cannot be met: " + ("it has no tokens" if s not in named else "it is below a token per window"))
    totals = {f"source {s}": n for s, n in named.items()}
    if whole > sum(totals.values()):
        totals[POOL] = whole - sum(totals.values())
    schedule = plan(totals, targets and {f"source {s}": w for s, w in targets.items()})
    # Where each file's tokens of a source begin among the source's tokens.
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queue = F.when(F.col("source").isin(sorted(named)), F.concat(F.lit("source "), "source")).otherwise(F.lit(POOL))
    begins = per_file.select("source", "part", queue.alias("queue"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    begins = stored(begins, "queue-begins")
    placed = tokens.join(begins, ["source", "part"]).select(
        "key", "source", "queue", (F.col("begin") + F.col("before")).alias("begin"), "doc_tokens", "ids", F.lit(0).cast("bigint").alias("skip")
    )
    if POOL in totals:
        runs = stored(pool_runs(per_source.filter(~F.col("source").isin(sorted(named))), totals[POOL]), "pool-runs")
        stop = F.col("begin") + F.col("doc_tokens")
        first = lambda r: F.greatest(F.col("begin"), r * RUN)
        piece = lambda r: F.struct(
            r.alias("run"), first(r).alias("at"),
            F.substring("ids", ((first(r) - F.col("begin")) * width + 1).cast("int"), ((F.least(stop, (r + 1) * RUN) - first(r)) * width).cast("int")).alias("ids"),
        )
        of_doc = F.transform(F.sequence(F.floor(F.col("begin") / RUN), F.floor((stop - 1) / RUN)), piece)
        dealt = placed.filter(F.col("queue") == POOL).select("key", "source", "queue", "begin", "doc_tokens", F.explode(of_doc).alias("x"))
        dealt = dealt.select("key", "source", "queue", F.col("begin").alias("doc_at"), "doc_tokens", "x.run", "x.at", "x.ids").join(runs, ["source", "run"])
        dealt = dealt.select("key", "source", "queue", (F.col("run_at") + F.col("at") - F.col("run") * RUN).alias("begin"), "doc_tokens", "ids", (F.col("at") - F.col("doc_at")).alias("skip"))
        placed = placed.filter(F.col("queue") != POOL).unionByName(dealt)
    placed = placed.drop("source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queues, begins, ids, skips = (batch.column(c).to_pylist() for c in ("queue", "begin", "ids", "skip"))
            for lo in range(0, batch.num_rows, 256):
                rows, starts, lengths, sequences, offsets, parts = [], [], [], [], [], []
                for n in range(lo, min(lo + 256, batch.num_rows)):
                    size = len(ids[n]) // width
                    start, sequence, offset = cut(schedule, queues[n], begins[n], size)
                    length = np.diff(np.r_[start, size])
                    rows.append(np.full(len(start), n))
                    starts.append(start + skips[n])
                    lengths.append(length)
                    sequences.append(sequence)
                    offsets.append(offset)
                    parts.append(np.frombuffer(ids[n], dtype=kind).astype("<u4"))
                row = np.concatenate(rows)
                length = np.concatenate(lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row)), pa.array(np.concatenate(starts)), pa.array(length),
                     bpe.slices(np.concatenate(parts), length), batch.column("doc_tokens").take(pa.array(row)),
                     pa.array(np.concatenate(sequences)), pa.array(np.concatenate(offsets))],
                    [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    zero = F.lit(0).cast("bigint")
    schema = placed.select(
        F.col("key").alias(key), zero.alias("start"), zero.alias("length"), "ids", "doc_tokens", zero.alias("sequence_id"), zero.alias("offset")
    ).schema
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id, ids, pieces: the packed sequences; each gathers at most WINDOW tokens."""
    row = F.struct("offset", "length", "start", key, "ids")
    gathered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    return gathered.select(
        "sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.transform("p", lambda x: F.struct(x[key].alias(key), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
