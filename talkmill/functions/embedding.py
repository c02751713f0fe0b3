"""Hash-projection embedding and stored vectors."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from talkmill.functions.text import WS

# Shape of the hash projection.
HASH_DIM = 64
HASH_SLOTS = 4
HASH_SEED = 5381

_WORD = re.compile(f"[^{WS}]+")

#: Words that are projected at once, at some 300 bytes each; a text with more is taken alone.
WORDS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class EmbeddingProvider:
    """Vectors for a text column: ``embed`` maps it to array<double> of ``dimension``, row by row."""

    id: str
    dimension: int
    embed: Callable[[Column], Column]


def _hash_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of words over UTF-16 units, one character position at a time for all words."""
    sizes = np.array([len(w.encode("utf-16-le")) // 2 for w in words])
    order = np.argsort(-sizes, kind="stable")
    units = np.frombuffer("".join(words[i] for i in order).encode("utf-16-le"), dtype="<u2").astype(np.uint64)
    longest_first = sizes[order]
    starts = np.cumsum(longest_first) - longest_first
    hashes = np.full(len(words), HASH_SEED, dtype=np.uint64)
    for place in range(longest_first[0]):
        n = np.searchsorted(-longest_first, -place, side="left")
        hashes[:n] = (hashes[:n] * 33 & 0xFFFFFFFF) ^ units[starts[:n] + place]
    out = np.empty(len(words), dtype=np.int64)
    out[order] = hashes.astype(np.int64)
    return out, sizes


def project_texts(texts: list[str], max_words: int | None = None) -> np.ndarray:
    """Unit vectors of a batch of texts, of all their words or the first ones; a text without words gives zeros.

    Spark hands over thousands of texts at once; a bounded number of words is worked on at a time.
    """
    out = np.zeros((len(texts), HASH_DIM))
    held, n, done = [], 0, 0
    for i, text in enumerate(texts):
        words = _WORD.findall(text)[:max_words]
        if held and n + len(words) > WORDS_AT_ONCE:
            out[done:i] = _project(held)
            held, n, done = [], 0, i
        held.append(words)
        n += len(words)
    if held:
        out[done:] = _project(held)
    return out


def _project(words: list[list[str]]) -> np.ndarray:
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([w for ws in words for w in ws], dtype=object)
    if len(flat) == 0:
        return np.zeros((len(words), HASH_DIM))
    codes, distinct = pd.factorize(flat)
    known, lengths = _hash_words(distinct.tolist())
    hashes, sizes = known[codes], lengths[codes]
    owner = np.repeat(np.arange(len(words)), counts)
    index = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    k = np.arange(HASH_SLOTS, dtype=np.int64)
    slots = (hashes[:, None] + k * 17 + index[:, None]) % HASH_DIM
    # The shift works on the signed 32-bit value, and the remainder keeps its sign.
    signed = hashes.astype(np.uint32).view(np.int32)
    rest = np.fmod(signed[:, None] >> (k * 8).astype(np.int32), 256)
    wave = np.sin(rest * 0.01) + np.cos((index + 1) * (sizes + 1) * 0.01)[:, None]
    cells = (owner[:, None] * HASH_DIM + slots).ravel()
    vectors = np.bincount(cells, weights=wave.ravel(), minlength=len(words) * HASH_DIM).reshape(len(words), HASH_DIM)
    norms = np.sqrt(np.sum(vectors * vectors, axis=1))
    return vectors / np.where(norms == 0, 1.0, norms)[:, None]


def hash_embedding(text: Column, max_words: int | None = None) -> Column:
    """64-dimensional pseudo-embedding of each text; null stays null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        vectors = iter(project_texts(texts.dropna().tolist(), max_words))
        return pd.Series([None if missing else next(vectors) for missing in texts.isna()], dtype="object")

    return embed(text)


def hash_provider(max_words: int | None = None) -> EmbeddingProvider:
    return EmbeddingProvider("hash-projection-local-64", HASH_DIM, lambda text: hash_embedding(text, max_words))


#: Texts that a model is given at once.
MODEL_BATCH = 256


def batched_provider(
    id: str, dimension: int, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = MODEL_BATCH,
) -> EmbeddingProvider:
    """A provider around a model that is costly to set up.

    ``load`` gives a function from texts to a matrix with a row per text. It is called once in each Python worker, which Spark
    keeps from task to task; a worker that is lost loads it again. Texts go to the model ``batch`` at a time, nulls not at
    all, and a matrix of another shape than (texts, dimension) stops the job.
    """

    def embed(text: Column) -> Column:
        @F.pandas_udf(ArrayType(DoubleType()))
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            loaded = vars(sys).setdefault("_talkmill_models", {})  # of the process, since functions arrive anew with each task
            if id not in loaded:
                loaded[id] = load()
            for texts in parts:
                there, rows = texts.dropna().tolist(), []
                for lo in range(0, len(there), batch):
                    some = there[lo:lo + batch]
                    made = np.asarray(loaded[id](some), dtype=float)
                    if made.shape != (len(some), dimension):
                        raise ValueError(f"{id} gave {made.shape} for {len(some)} texts of dimension {dimension}")
                    rows.extend(made)
                vectors = iter(rows)
                yield pd.Series([None if missing else next(vectors) for missing in texts.isna()], dtype="object")

        return run(text)

    return EmbeddingProvider(id, dimension, embed)


def parse_vector(raw: Column) -> Column:
    """JSON text to array<double>; null for bad JSON, a non-array or a value that is no number."""
    parsed = F.try_parse_json(raw)
    is_array = F.schema_of_variant(parsed).startswith("ARRAY")
    items = F.when(is_array, parsed).cast("array<variant>")
    numbers = F.transform(
        items,
        lambda v: F.when(v.isNull() | F.is_variant_null(v), F.lit(0.0)).otherwise(F.try_variant_get(v, "$", "double")),
    )
    usable = ~F.exists(numbers, lambda n: n.isNull() | F.isnan(n))
    return F.when(raw.rlike(r"(?s)^\s*\[.*\]\s*$") & usable, numbers)
