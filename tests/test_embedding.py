import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import table, values
from talkmill.functions.embedding import EmbeddingProvider, parse_vector, project_texts
from talkmill.operators.embeddings import backfill_embeddings, cosine_topk, with_embeddings


def by_loop(text):
    """The projection word by word, in plain Python."""
    vec = [0.0] * 64
    for i, word in enumerate(text.split()[:512]):
        raw = word.encode("utf-16-le")
        h = 5381
        for j in range(0, len(raw), 2):
            h = ((h * 33) % 2**32) ^ (raw[j] + 256 * raw[j + 1])
        signed = h - 2**32 if h >= 2**31 else h
        for k in range(4):
            s = math.fmod(signed >> (8 * k), 256)
            vec[(h + 17 * k + i) % 64] += math.sin(0.01 * s) + math.cos(0.01 * (i + 1) * (len(raw) // 2 + 1))
    norm = math.sqrt(sum(v * v for v in vec)) or 1.0
    return [v / norm for v in vec]


TEXTS = ["", "hello world", "a", "zz top zz " * 171, "x" * 3000, "caf" + chr(233) + " " + chr(0x1F600), "word " * 512 + "more"]


def test_vectors_equal_a_plain_loop():
    for text, got in zip(TEXTS, project_texts(TEXTS, 512)):
        assert got == pytest.approx(by_loop(text), abs=1e-12)
    assert project_texts([""]).tolist() == [[0.0] * 64]


def test_words_past_the_limit_do_not_count():
    assert project_texts([TEXTS[-1]], 512)[0] == pytest.approx(project_texts(["word " * 512])[0])


def test_memory_does_not_grow_with_the_batch():
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(i % 800)) for i in range(3000)]
    tracemalloc.start()
    got = project_texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # words and arrays of the whole batch at once take 256 MB
    assert all(np.array_equal(got[i], project_texts([texts[i]])[0]) for i in range(0, 3000, 97))


def test_backfill_keeps_what_is_there(spark):
    chunks = table(spark, "chunks", [{"id": "a", "text": "one two"}, {"id": "b", "text": "three", "embedding": [1.0]}])
    once = backfill_embeddings(chunks)
    rows = {r["id"]: r["embedding"] for r in once.collect()}
    assert rows["b"] == [1.0] and rows["a"] == pytest.approx(by_loop("one two"))
    assert {r["id"]: r["embedding"] for r in backfill_embeddings(once).collect()} == rows


def test_wrong_dimension_stops_the_job(spark):
    chunks = table(spark, "chunks", [{"id": "a", "text": "x"}])
    short = EmbeddingProvider("short", 3, lambda c: F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="dimension mismatch"):
        with_embeddings(chunks, short).collect()
    assert len(with_embeddings(chunks).collect()[0]["embedding"]) == 64


def test_stored_vectors(spark):
    raw = ["[1, 2.5]", "[]", "{}", "[1, \"x\"]", "[1, null]", "oops", "[1] x", None, "", "[\"3\"]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r["v"] for r in df.select("i", parse_vector(F.col("r")).alias("v")).orderBy("i").collect()]
    assert got == [[1.0, 2.5], [], None, None, [1.0, 0.0], None, None, None, None, [3.0]]


def test_cosine_topk(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [])], "id string, embedding array<double>")
    got = cosine_topk(rows, F.array(F.lit(1.0), F.lit(0.0)), 3).collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]
    assert got[1]["cosine"] == pytest.approx(math.sqrt(0.5)) and got[2]["cosine"] == 0.0


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    import os
    import uuid

    import numpy as np

    from talkmill.functions.embedding import batched_provider

    log = str(tmp_path)

    def load():
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(texts):
            assert 0 < len(texts) <= 3
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    provider = batched_provider(f"test-{uuid.uuid4().hex}", 2, load, batch=3)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(40)], "id int, text string").repartition(8)
    for _ in range(2):
        got = dict(values(rows.select("id", provider.embed(F.col("text")).alias("v")), "id", "v"))
        assert got == {i: None if i % 5 == 0 else [float(i), 1.0] for i in range(40)}
    workers = [n.split("-")[0] for n in os.listdir(log)]
    assert workers and len(workers) == len(set(workers))
    wrong = batched_provider(f"test-{uuid.uuid4().hex}", 3, load, batch=3)
    with pytest.raises(Exception, match="dimension 3"):
        rows.select(wrong.embed(F.col("text"))).collect()
