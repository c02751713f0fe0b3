"""Tables around the behavioural profile: digests for a model, and what comes back from it.

The model call itself is the user's. It maps (batch_no, digests) to (batch_no, response).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import clamp01
from talkmill.functions.rows import each
from talkmill.functions.text import strip_ws
from talkmill.operators.analytics import session_profiles
from talkmill.schema import PATTERN_CATEGORIES, conform, make_id
from talkmill.session import cut_lineage

# Sizes, defaults and texts of the profile.
DIGEST_BATCH = 50
SNIPPET_CHARS = 150
DIGEST_KEYWORDS, DIGEST_PROJECTS, DIGEST_THEMES = 8, 5, 5
DEFAULT_SCORE = 0.3
PATTERN_EVIDENCE, PATTERN_EVIDENCE_SCORE = 10, 0.7
PATTERN_EXPLANATION = "Behavioral pattern evidence"
PROMPT_MESSAGES, PROMPT_CHARS = 10, 200
PROMPT_TITLES = 20
MAX_TOPICS = 10


def _labels(intelligence: DataFrame, entity_type: str) -> DataFrame:
    """All labels of a session's links of a type, in order of their ids, and their number."""
    links = intelligence.filter(F.col("entity_type") == entity_type)
    listed = links.groupBy("session_id").agg(
        F.count("*").alias(f"{entity_type}_count"), F.array_sort(F.collect_list(F.struct("entity_id", "label"))).alias("l")
    )
    return listed.select("session_id", f"{entity_type}_count", F.col("l.label").alias(f"linked_{entity_type}s"))


def session_digests(
    sessions: DataFrame, messages: DataFrame, analytics: DataFrame, intelligence: DataFrame
) -> DataFrame:
    """One digest per session, with all labels it is linked to; the compact batches cut them."""
    user = messages.filter("role = 'user'").select("session_id", "sort_order", F.substring("content_text", 1, SNIPPET_CHARS).alias("s"))
    first = user.groupBy("session_id").agg(F.min_by("s", "sort_order").alias("first_user"))
    none = F.array().cast("array<string>")
    rows = (
        sessions.select(F.col("id").alias("session_id"), F.coalesce("title", F.lit("Untitled")).alias("title"), "started_at")
        .join(session_profiles(analytics), "session_id", "left")
        .join(_labels(intelligence, "project"), "session_id", "left")
        .join(_labels(intelligence, "theme"), "session_id", "left")
        .join(first, "session_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    counts = ["message_count", "user_msg_count", "assistant_msg_count", "word_count", "project_count", "theme_count"]
    lists = ["top_keywords", "linked_projects", "linked_themes"]
    snippet = F.when(F.col("message_count") > 0, F.coalesce("first_user", F.lit(""))).otherwise(F.lit(""))
    return rows.select(
        "session_id", "title", "started_at", "duration_minutes", snippet.alias("first_user_snippet"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in counts],
        *[F.coalesce(F.col(c), none).alias(c) for c in lists],
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in a total order, without gathering them in one task.

    Rows are range-partitioned and sorted, stored, and numbered inside each partition; a partition's first
    number is the size of those before it. Only one row per partition is summed up in one place. Storing
    keeps the ranges fixed, so a lost executor cannot shift the numbers.
    """
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", place)
    stored = cut_lineage(ordered)
    part = F.shiftright("_p", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_p") - F.shiftleft(F.col("_part"), 33)
    return (
        stored.withColumn("_part", part).join(starts, "_part")
        .withColumn(name, (F.col("_start") + within).cast("bigint"))
        .drop("_p", "_part", "_start")
    )


def digest_batches(digests: DataFrame, size: int = DIGEST_BATCH) -> DataFrame:
    """(batch_no, digest_count, digests): compact JSON of each ``size`` digests, newest session first."""
    rows = numbered(digests, [F.desc_nulls_last("started_at"), F.col("session_id")], "row_no")
    compact = F.struct(
        F.col("session_id").alias("id"), "title",
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"),
        F.col("duration_minutes").alias("duration_min"), F.col("message_count").alias("msgs"),
        F.col("user_msg_count").alias("user_msgs"), F.col("word_count").alias("words"),
        F.slice("top_keywords", 1, DIGEST_KEYWORDS).alias("keywords"),
        F.slice("linked_projects", 1, DIGEST_PROJECTS).alias("projects"),
        F.slice("linked_themes", 1, DIGEST_THEMES).alias("themes"),
        F.col("first_user_snippet").alias("snippet"),
    )
    batch = F.floor(F.col("row_no") / size)
    grouped = rows.groupBy(batch.alias("batch_no")).agg(
        F.count("*").alias("digest_count"), F.array_sort(F.collect_list(F.struct("row_no", compact.alias("d")))).alias("ds")
    )
    return grouped.select(
        "batch_no", "digest_count", F.to_json(F.col("ds.d"), {"ignoreNullFields": "false"}).alias("digests")
    )


def _strings(array: Column) -> Column:
    texts = F.filter(array.cast("array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(texts, lambda v: F.try_variant_get(v, "$", "string"))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text_or(value: Column, default: str) -> Column:
    """Any JSON value as text; the default for null or an absent one."""
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent, F.lit(default)).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def _score(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    parsed = F.when(number, F.try_variant_get(value, "$", "double"))
    return F.coalesce(clamp01(parsed), F.lit(DEFAULT_SCORE))


def _array_or_empty(value: Column) -> Column:
    return F.when(_is(value, "ARRAY"), _strings(value)).otherwise(F.array().cast("array<string>"))


def parse_profile_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, traits) from (batch_no, response).

    A response needs a text summary and a trait array; another one is dropped whole. Traits come as
    batch_no, trait_no, label, description, category, scores and evidence_session_ids.
    """
    parsed = responses.select("batch_no", F.try_parse_json("response").alias("v")).select(
        "batch_no",
        *[F.variant_get("v", f"$.{c}", "variant").alias(c) for c in ("summary", "strengths", "growth_areas", "work_style", "traits")],
    )
    usable = parsed.filter(_is(F.col("summary"), "STRING") & _is(F.col("traits"), "ARRAY"))
    profiles = usable.select(
        "batch_no",
        F.try_variant_get("summary", "$", "string").alias("summary"),
        _array_or_empty(F.col("strengths")).alias("strengths"),
        _array_or_empty(F.col("growth_areas")).alias("growth_areas"),
        F.when(_is(F.col("work_style"), "STRING"), F.try_variant_get("work_style", "$", "string"))
        .otherwise(F.lit("Unknown")).alias("work_style"),
    )
    objects = F.filter(F.col("traits").cast("array<variant>"), lambda t: _is(t, "OBJECT") | _is(t, "ARRAY"))
    listed = each(usable, objects, "trait_no", "t", "batch_no")

    def field(name: str) -> Column:
        return F.try_variant_get("t", f"$.{name}", "variant")

    traits = listed.select(
        "batch_no", "trait_no",
        _text_or(field("label"), "Unknown pattern").alias("label"),
        _text_or(field("description"), "").alias("description"),
        _text_or(field("category"), "behavioral").alias("category"),
        _score(field("confidence")).alias("confidence"),
        _score(field("impact_score")).alias("impact_score"),
        _array_or_empty(field("evidence_session_ids")).alias("evidence_session_ids"),
    )
    return profiles, traits


def _label_key() -> Column:
    return strip_ws(F.lower("label"))


def merge_traits(traits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, evidence): one trait per label whatever its case, and the union of their session ids.

    The highest confidence wins, the earlier one on a tie. Evidence stays one row per (label_key, session_id)
    with its order, so a label given very often is never gathered into one list.
    """
    keyed = traits.withColumn("label_key", _label_key())
    seq = F.struct("batch_no", "trait_no")
    best = F.struct((-F.col("confidence")).alias("c"), "batch_no", "trait_no")
    fields = F.struct("label", "description", "category", "confidence", "impact_score")
    merged = keyed.groupBy("label_key").agg(F.min_by(fields, best).alias("t"), F.min(seq).alias("first"))
    merged = merged.select("label_key", "t.*", "first")
    ids = each(keyed, F.col("evidence_session_ids"), "pos", "session_id", "label_key", "batch_no", "trait_no")
    evidence = ids.groupBy("label_key", "session_id").agg(F.min(F.struct("batch_no", "trait_no", "pos")).alias("first"))
    return merged, evidence


def upsert_patterns(existing: DataFrame, merged: DataFrame, as_of: Column) -> DataFrame:
    """Patterns with the traits merged in by exact label.

    A known pattern gets description, scores and last_seen_at, and keeps its category; of equal labels the
    smallest id is the one updated.
    """
    category = F.when(F.col("category").isin(PATTERN_CATEGORIES), F.col("category")).otherwise(F.lit("other"))
    new = merged.select(
        "label", F.col("description").alias("n_description"), category.alias("n_category"),
        clamp01(F.col("confidence")).alias("n_confidence"), clamp01(F.col("impact_score")).alias("n_impact"),
    )
    chosen = existing.groupBy("label").agg(F.min("id").alias("id"))
    targets = chosen.join(new, "label").drop("label")
    hit = F.col("n_confidence").isNotNull()
    updated = existing.join(targets, "id", "left").select(
        "id", "label", "category", "first_seen_at",
        *[F.when(hit, F.col(n)).otherwise(F.col(c)).alias(c)
          for c, n in (("description", "n_description"), ("confidence", "n_confidence"), ("impact_score", "n_impact"))],
        F.when(hit, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    added = new.join(existing.select("label").distinct(), "label", "left_anti").select(
        make_id("pattern", F.col("label")).alias("id"), "label", F.col("n_description").alias("description"),
        F.col("n_category").alias("category"), F.col("n_confidence").alias("confidence"),
        F.col("n_impact").alias("impact_score"), as_of.alias("first_seen_at"), as_of.alias("last_seen_at"),
    )
    return conform(updated, "patterns").unionByName(conform(added, "patterns"))


def pattern_evidence(
    merged: DataFrame, evidence: DataFrame, patterns: DataFrame, sessions: DataFrame, as_of: Column,
    limit: int = PATTERN_EVIDENCE,
) -> DataFrame:
    """Links from each merged trait's pattern to its first sessions that exist."""
    ids = sessions.select(F.col("id").alias("session_id"))
    valid = evidence.join(ids, "session_id", "left_semi")
    order = Window.partitionBy("label_key").orderBy("first", "session_id")
    top = valid.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)
    named = patterns.groupBy("label").agg(F.min("id").alias("entity_id"))
    rows = top.join(merged.select("label_key", "label"), "label_key").join(named, "label")
    links = rows.select(
        make_id("evidence", F.lit("pattern"), F.col("entity_id"), F.col("session_id"), as_of).alias("id"),
        F.lit("pattern").alias("entity_type"), "entity_id", "session_id",
        F.lit(PATTERN_EXPLANATION).alias("explanation"), F.lit(PATTERN_EVIDENCE_SCORE).alias("evidence_score"),
        as_of.alias("created_at"),
    )
    return conform(links, "evidence_links")


def profile_row(profiles: DataFrame, sessions: DataFrame, model: str, as_of: Column) -> DataFrame:
    """The single profile row: the last readable batch's, or none."""
    fields = F.struct("summary", "strengths", "growth_areas", "work_style")
    last = profiles.agg(F.max_by(fields, "batch_no").alias("p")).filter("p is not null")
    rows = last.select("p.*").select(
        F.lit("default").alias("id"), "*", F.lit(model).alias("model_used"), as_of.alias("computed_at"),
    )
    return conform(
        rows.withColumn("session_count_at_computation", sessions.agg(F.count("*")).scalar()), "user_profile"
    )


def pattern_list(patterns: DataFrame, evidence: DataFrame, category: str | None = None) -> DataFrame:
    """Patterns by confidence, then newest, one row per evidence session (or one without)."""
    if category:
        patterns = patterns.filter(F.col("category") == category)
    links = evidence.filter("entity_type = 'pattern'").select(F.col("entity_id").alias("id"), "session_id")
    return patterns.join(links, "id", "left").orderBy(F.desc("confidence"), F.desc("last_seen_at"), "id", "session_id")


def prompt_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Model input per session: title and the start of its first user messages."""
    user = messages.filter("role = 'user'").select("session_id", "sort_order", F.substring("content_text", 1, PROMPT_CHARS).alias("s"))
    order = Window.partitionBy("session_id").orderBy("sort_order")
    top = user.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= PROMPT_MESSAGES)
    joined = top.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rn", "s"))).alias("m"))
    texts = joined.select("session_id", F.array_join(F.col("m.s"), "\n").alias("user_messages"))
    named = sessions.select(F.col("id").alias("session_id"), F.coalesce("title", F.lit("Untitled session")).alias("title"))
    return named.join(texts, "session_id", "left").withColumn("user_messages", F.coalesce("user_messages", F.lit("")))


def prompt_titles(projects: DataFrame, evidence: DataFrame, sessions: DataFrame) -> DataFrame:
    """Model input per project: its title and the titles of its newest sessions."""
    links = evidence.filter("entity_type = 'project'").groupBy("entity_id", "session_id").agg(F.max("created_at").alias("at"))
    titled = sessions.filter(F.nullif("title", F.lit("")).isNotNull()).select(F.col("id").alias("session_id"), "title")
    order = Window.partitionBy("entity_id").orderBy(F.desc("at"), "session_id")
    top = links.join(titled, "session_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= PROMPT_TITLES)
    listed = top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("t"))
    joined = listed.select(F.col("entity_id").alias("id"), F.array_join(F.col("t.title"), ", ").alias("session_titles"))
    return projects.select("id", "canonical_title").join(joined, "id", "left").withColumn(
        "session_titles", F.coalesce("session_titles", F.lit(""))
    )


def parse_topics(responses: DataFrame) -> DataFrame:
    """(session_id, topics) from (session_id, response): an array, or an object with topics; strings, at most ten."""
    v = F.try_parse_json("response")
    rows = responses.withColumn("v", v).withColumn("inner", F.try_variant_get("v", "$.topics", "variant"))
    found = F.when(_is(F.col("v"), "ARRAY"), F.col("v")).when(_is(F.col("inner"), "ARRAY"), F.col("inner"))
    return rows.withColumn("found", found).select(
        "session_id", F.slice(_array_or_empty(F.col("found")), 1, MAX_TOPICS).alias("topics")
    )
