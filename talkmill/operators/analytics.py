"""Per-session metrics and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import round_half_up
from talkmill.functions.rows import each
from talkmill.functions.stopwords import STOPWORDS
from talkmill.functions.text import keyword_words, word_count
from talkmill.schema import conform

# Keywords kept per session, and the shortest keyword.
TOP_KEYWORDS = 15
MIN_KEYWORD_CHARS = 3


def session_metrics(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts, words and duration, one row per session; zeros where there are no messages.

    One aggregate, combined before the shuffle, gives all of it.
    """
    per_session = messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_msg_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_msg_count"),
        F.sum(word_count(F.col("content_text"))).alias("word_count"),
        F.min_by("timestamp", "sort_order").alias("first_ts"),
        F.max_by("timestamp", "sort_order").alias("last_ts"),
    )
    joined = sessions.select(F.col("id").alias("session_id"), "started_at", "ended_at").join(
        per_session, "session_id", "left"
    )
    counts = ["message_count", "user_msg_count", "assistant_msg_count", "word_count"]
    return joined.select(
        "session_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        session_duration().alias("duration_minutes"),
    )


def session_duration() -> Column:
    """Minutes from the first to the last message, to 0.1; null below two messages or when not positive."""
    first = F.coalesce("first_ts", "started_at")
    last = F.coalesce("last_ts", "ended_at")
    millis = F.unix_millis(last) - F.unix_millis(first)
    return F.when((F.col("message_count") >= 2) & (millis > 0), round_half_up(millis / F.lit(60000), 1))


def keyword_counts(messages: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """session_id, word, n, first: counts of the words that may be keywords, and where each first stands."""
    words = each(messages, keyword_words(F.col("content_text")), "pos", "word", "session_id", "sort_order")
    usable = (
        (F.length("word") >= MIN_KEYWORD_CHARS)
        & ~F.col("word").rlike("^[0-9]+$")
        & ~F.col("word").isin(stopwords if stopwords is not None else STOPWORDS)
    )
    # (sort_order, pos) packed in one long keeps the aggregate on the hash path.
    place = F.shiftleft(F.col("sort_order").cast("bigint"), 32) + F.col("pos")
    return words.filter(usable).groupBy("session_id", "word").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def top_keywords(messages: DataFrame, n: int = TOP_KEYWORDS, stopwords: list[str] | None = None) -> DataFrame:
    """session_id, top_keywords: the most frequent words, ties by first occurrence."""
    order = Window.partitionBy("session_id").orderBy(F.desc("n"), "first")
    ranked = keyword_counts(messages, stopwords).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    listed = ranked.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rn", "word"))).alias("w"))
    return listed.select("session_id", F.col("w.word").alias("top_keywords"))


def compute_session_analytics(
    sessions: DataFrame, messages: DataFrame, as_of: Column, stopwords: list[str] | None = None
) -> DataFrame:
    rows = session_metrics(sessions, messages).join(top_keywords(messages, stopwords=stopwords), "session_id", "left")
    none = F.array().cast("array<string>")
    return conform(
        rows.withColumn("top_keywords", F.coalesce("top_keywords", none)).withColumn("computed_at", as_of),
        "session_analytics",
    )


def update_session_analytics(
    existing: DataFrame,
    sessions: DataFrame,
    messages: DataFrame,
    as_of: Column,
    refresh: bool = False,
    stopwords: list[str] | None = None,
) -> DataFrame:
    """Add rows for sessions that have none. ``refresh`` computes the given sessions again instead."""
    if refresh:
        fresh = compute_session_analytics(sessions, messages, as_of, stopwords)
        kept = existing.join(fresh.select("session_id"), "session_id", "left_anti")
        return conform(kept, "session_analytics").unionByName(fresh)
    done = existing.select(F.col("session_id").alias("id"))
    new = sessions.join(done, "id", "left_anti")
    theirs = messages.join(new.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return conform(existing, "session_analytics").unionByName(
        compute_session_analytics(new, theirs, as_of, stopwords)
    )


def parse_keywords(raw: Column) -> Column:
    """Keywords stored as JSON text: strings only, an empty list for anything unreadable."""
    items = F.from_json(raw, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def session_profiles(analytics: DataFrame) -> DataFrame:
    """Analytics rows ready to read, from the array form or the older JSON text form."""
    if "top_keywords_json" in analytics.columns:
        analytics = analytics.withColumn("top_keywords", parse_keywords(F.col("top_keywords_json")))
    none = F.array().cast("array<string>")
    counts = ["message_count", "user_msg_count", "assistant_msg_count", "word_count"]
    return analytics.select(
        "session_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        "duration_minutes",
        F.coalesce("top_keywords", none).alias("top_keywords"),
    )
