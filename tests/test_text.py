import time

import pytest
from pyspark.sql import functions as F

from helpers import values
from talkmill.functions import text as tx

NBSP, BOM_CHAR = chr(0xA0), chr(0xFEFF)


def apply(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_words_split_on_every_space_character(spark):
    counts = apply(spark, tx.word_count, f"a{NBSP}b", f"{BOM_CHAR}a b{BOM_CHAR}", "", "  \n ", f"x{chr(0x3000)}y\tz")
    assert counts == [2, 2, 0, 0, 3]
    assert apply(spark, tx.strip_ws, f"{NBSP} a b \n") == ["a b"]


def test_spaces_are_told_like_the_listed_ones(spark):
    points = spark.range(0x110000).filter("id < 55296 OR id > 57343")
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")  # after a byte order mark, which decoding takes off
    assert points.filter(char.rlike(f"^{tx.NOT_WS}$") == char.rlike(f"^[{tx.WS}]$")).count() == 0
    around = F.concat(char, F.lit("a"), char, F.lit("b"), char)
    stripped = F.when(char.rlike(f"^[{tx.WS}]$"), F.concat(F.lit("a"), char, F.lit("b"))).otherwise(around)
    assert points.filter(tx.strip_ws(around) != stripped).count() == 0
    assert apply(spark, tx.strip_ws, "a " + chr(0x85), None, "", NBSP) == ["a " + chr(0x85), None, "", ""]


def test_counting_words_asks_no_ascii_character_for_every_space(spark):
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.concat("id", F.lit(" plain words ")), 500).alias("t")).localCheckpoint()

    def seconds(pattern):
        start = time.perf_counter()
        total = texts.agg(F.sum(pattern)).first()[0]
        return time.perf_counter() - start, total

    ways = [tx.word_count(F.col("t")), F.regexp_count("t", F.lit(f"[^{tx.WS}]+"))]
    (quick, n), (slow, m) = [min(seconds(w) for _ in range(3)) for w in ways]
    assert n == m == 400 * 500 * 3 and quick * 2 < slow


def test_keyword_words_keep_apostrophes_and_split_on_accents(spark):
    assert apply(spark, tx.keyword_words, "Don't re-use Caf" + chr(233) + "s 42") == [["don't", "re-use", "caf", "s", "42"]]


def test_terms_keep_accents_and_marks_but_not_punctuation(spark):
    e_acute, mark = chr(233), chr(0x301)
    assert apply(spark, tx.terms, f"Caf{e_acute}-bar e{mark}x _y_", "!!") == [[f"caf{e_acute}", "bar", f"e{mark}x", "y"], []]


def windows_by_loop(text, size, overlap):
    out, start = [], 0
    while text:
        end = min(start + size, len(text))
        out.append((start, end, text[start:end]))
        if end == len(text):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(8000, 200), (10, 3), (5, 0), (4, 3)])
def test_windows_equal_a_loop(spark, size, overlap):
    texts = ["", "x" * 8000, "ab" * 4000 + "c", "q" * 15800, "q" * 15801, "abcdefghijklm", "abcde", "abcdef"]
    got = apply(spark, lambda c: tx.windows(c, size, overlap), *texts)
    for text, parts in zip(texts, got):
        assert [tuple(p) for p in parts or []] == windows_by_loop(text, size, overlap)


def test_windows_reject_bad_sizes():
    with pytest.raises(ValueError):
        tx.windows(None, 0, 0)
    with pytest.raises(ValueError):
        tx.windows(None, 5, 5)


def poly32(text):
    h = 0
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] + 256 * raw[i + 1]) & 0xFFFFFFFF
    return f"{abs(h - 2**32 if h > 0x7FFFFFFF else h):08x}"


def test_fingerprints(spark):
    texts = ["", "hello", "The quick brown fox " * 20, chr(0x1F600) + "x", chr(233)]
    assert apply(spark, lambda c: tx.fingerprint(c, "poly32"), *texts) == [poly32(t) for t in texts]
    assert len(apply(spark, tx.fingerprint, "a")[0]) == 64
    with pytest.raises(ValueError):
        tx.fingerprint(F.lit("a"), "md5")


def test_normalized_words_fold_ligatures_and_full_width(spark):
    got = apply(spark, tx.normalized_words, "Of" + chr(0xFB01) + "ce a " + chr(0xFF21) + chr(0xFF22), "A b!", "x1 X1 y2")
    assert got == [["office", "ab"], [], ["x1", "y2"]]


def test_stopwords():
    from talkmill.functions.stopwords import STOPWORDS

    assert {"the", "don't", "please", "www"} <= set(STOPWORDS)
    assert len(STOPWORDS) == len(set(STOPWORDS))


def test_phrase_regex_escapes(spark):
    df = spark.createDataFrame([("a.b (c) A.B", ["a.b", "(c)"])], "t string, k array<string>")
    out = df.select(F.regexp_replace("t", tx.phrase_regex(F.col("k")), F.lit("<$1>")).alias("o"))
    assert values(out, "o") == [("<a.b> <(c)> <A.B>",)]
