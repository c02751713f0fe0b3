"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each rule that failed, so a
policy is only a mask over the bits: applying another version, or asking what a rule alone would change, reads no text.

Words are runs outside ASCII white space. A null or empty text has no words and fails the base rules. Repeated rows are judged
each. Only the id and the text are read, so other columns may have any names. All work is inside one row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import split_words, text_or_empty

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger; ``fails`` is a condition on the measurements."""

    bit: int
    name: str
    fails: Callable[[], Column]


#: A bit, once given, keeps its meaning; a changed rule takes a new bit.
RULES = [
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeats_itself", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "words_too_short", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(3, "words_too_long", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule(4, "mostly_symbols", lambda: 2 * F.col("n_symbols") > F.col("n_words")),
    Rule(5, "repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule(6, "some_repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
]


def mask_of(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


BASE = mask_of("too_few_words", "repeats_itself")
#: Policies by version; a document is kept if it fails none of the rules in the mask.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask_of("words_too_short", "words_too_long", "mostly_symbols", "repeated_lines"),
    "v2_strict_lines": BASE | mask_of("words_too_short", "words_too_long", "mostly_symbols", "some_repeated_lines"),
}
CURRENT = "v1"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the measurements of every document."""
    n = F.col("n_words")
    whole = docs.select(key, text_or_empty(text).alias("__text"))
    split = whole.select(
        key, split_words(F.col("__text")).alias("__words"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    counted = split.select(
        key, "__words", "n_symbols", F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
    )
    # A window's hash and its place share one long, so that a plain sort of longs brings equal windows together.
    low = F.ceil(F.log2(n + 1)).cast("int")
    places = F.when(n >= 3, F.sequence(F.lit(0).cast("bigint"), n - 3)).otherwise(F.array().cast("array<bigint>"))
    word = lambda i: F.get("__words", i.cast("int"))
    # shiftleft takes an int only as a column through SQL, hence the product with a power of two.
    packed = counted.select(
        "*", low.alias("__low"), F.pow(F.lit(2.0), low).cast("bigint").alias("__span"), places.alias("__places")
    ).select(
        "*",
        F.sort_array(F.transform("__places", lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)) - F.pmod(
            F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col("__span")) + i)).alias("__sorted"),
    )
    return packed.select(key, *MEASURES[:5], repeat_words().alias("n_repeat_words"))


def repeat_words() -> Column:
    """Words in windows of three that are found twice or more.

    Windows meet by the upper bits of a hash and are compared word by word. If two different ones share those bits, the
    text takes the slower way, which sorts the windows themselves.
    """
    rows, span = F.col("__sorted"), F.col("__span")
    place = lambda x: F.pmod(x, span)
    word = lambda i: F.get("__words", i.cast("int"))
    same_hash = lambda x, y: (x - place(x)) == (y - place(y))

    def same_words(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        return (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))

    def twin(x: Column, y: Column) -> Column:
        return F.coalesce(same_hash(x, y), F.lit(False))

    clash = F.exists(
        F.filter(rows, lambda x, j: twin(x, F.get(rows, j + 1)) & ~same_words(x, F.get(rows, j + 1))), lambda x: x.isNotNull()
    )
    fast = F.transform(F.filter(rows, lambda x, j: twin(x, F.get(rows, j - 1)) | twin(x, F.get(rows, j + 1))), place)
    whole = F.array_sort(F.transform("__places", lambda i: F.struct(word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i"))))
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    slow = F.flatten(F.transform(
        F.array(whole),
        lambda s: F.transform(F.filter(s, lambda x, j: alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1))), lambda x: x["i"]),
    ))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(
        F.sort_array(F.when(clash, slow).otherwise(fast)),
        start,
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["total"] + i + 3 - F.greatest(i, acc["end"])).alias("total")),
        lambda acc: acc["total"],
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the measurements and ``failed``, the bits of the rules that the document fails."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, key, text).withColumn("failed", bits)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    failed = F.col("failed")
    return rows.withColumns({
        "base_failed": failed.bitwiseAND(F.lit(BASE)) != 0, "kept": failed.bitwiseAND(F.lit(POLICIES[version])) == 0
    })


def ablations(rows: DataFrame) -> DataFrame:
    """policy, rule, failing, failing_alone, kept_without: for every rule of every policy, the documents that fail it, those
    that fail nothing else of the policy, and how many would stay if the rule were left out.

    The documents are first counted by their bits, of which there are at most 2^rules; all else works on these counts.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    pairs = [(v, r.name, m, 1 << r.bit) for v, m in POLICIES.items() for r in RULES if m >> r.bit & 1]
    asked = spark.createDataFrame(pairs, "policy string, rule string, mask bigint, bit bigint")
    exploded = counts.select("failed", "n", F.explode(F.array(*[F.lit(v) for v in POLICIES])).alias("policy")).join(F.broadcast(asked), "policy")
    under = F.col("failed").bitwiseAND(F.col("mask"))
    return exploded.groupBy("policy", "rule").agg(
        F.coalesce(F.sum(F.when(under.bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(under == F.col("bit"), F.col("n"))), F.lit(0)).alias("failing_alone"),
        F.coalesce(F.sum(F.when(under.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
    )
