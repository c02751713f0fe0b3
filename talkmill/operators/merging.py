"""Likely duplicate projects: scoring, candidates, and merges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.numeric import clamp01, interval_iou, jaccard
from talkmill.functions.text import normalized_words, strip_ws
from talkmill.schema import conform
from talkmill.session import cut_lineage

# Weights and least score.
TITLE_WEIGHT, DESCRIPTION_WEIGHT, TIME_WEIGHT = 0.5, 0.25, 0.25
MIN_COMBINED = 0.55

# Pairs that are wanted at most; a parameter of the jobs.
MAX_PAIRS = 500
_EPS = 1e-9
_EMPTY_WORD = ""


def scoring_features(projects: DataFrame) -> DataFrame:
    """id, tw (title words), dw (description words, null without a description), lo and hi in milliseconds."""
    described = F.length(strip_ws(F.coalesce("description", F.lit("")))) > 0
    start, end = (F.coalesce(F.unix_millis(c), F.lit(0)) for c in ("first_seen_at", "last_seen_at"))
    return projects.select(
        "id",
        F.array_sort(normalized_words(F.col("canonical_title"))).alias("tw"),
        F.when(described, F.array_sort(normalized_words(F.col("description")))).alias("dw"),
        F.least(start, end).alias("lo"),
        F.greatest(start, end).alias("hi"),
    )


_SCORES = ["score_combined", "score_title", "score_description", "score_temporal"]
_PAIR = ["project_a_id", "project_b_id"]


#: The search looks at these scores first, and at the least one only where good pairs lack. Each costs a pass over the profiles.
LEVELS = (0.9,)
#: Title similarities between the least and the one that needs no like description are cut into so many bands.
BANDS = 3
#: From this similarity on, sizes and places of a shared word are part of the key that two profiles meet on.
PLACED_FROM = 0.5
#: Profiles of a word that one task compares with others.
WORD_SLICE = 1000
#: Overlaps for which time cells are laid out; below the first, all members of two profiles are compared.
OVERLAPS = (0.2, 0.5, 0.7, 0.85, 0.93, 0.97, 0.99, 0.999, 1.0)
_TEXTS = ["score_title", "score_description", "text", "share"]


def _first_members(rows: DataFrame, alike: list[str], keep: int | None) -> DataFrame:
    """The first rows by id of each group that scores alike.

    Exact for the best ``keep - 1`` pairs: replacing a later member by an earlier one never makes a pair
    come later, so enough better pairs exist without the later members. Copies thus never pair up in full.
    """
    if keep is None:
        return rows
    order = Window.partitionBy(*alike).orderBy("id")
    return rows.withColumn("_m", F.row_number().over(order)).filter(F.col("_m") <= keep).drop("_m")


def _profiles(features: DataFrame) -> DataFrame:
    """pid, tw, dw, and t and d: the words as (number of profiles that have it, word), rare ones first. One row per distinct text."""
    rows = cut_lineage(features.groupBy("pid").agg(F.first("tw").alias("tw"), F.first("dw").alias("dw")))

    def ranked(words: str, out: str) -> DataFrame:
        own = F.when(F.size(words) == 0, F.array(F.lit(_EMPTY_WORD))).otherwise(F.col(words))
        listed = rows.filter(F.col(words).isNotNull()).select("pid", F.explode(own).alias("w"))
        counts = listed.groupBy("w").agg(F.count("*").alias("n"))
        return listed.join(counts, "w").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias(out))

    return rows.join(ranked("tw", "t"), "pid").join(ranked("dw", "d"), "pid", "left")


def _prefix(size: Column, least: float) -> Column:
    """Of two sets that similar, each has one shared word among so many of its rarest."""
    return (size - F.ceil(size * F.lit(least - _EPS)) + 1).cast("int")


def _keyed(rows: DataFrame, words: str, least: float, out: str, asking: bool) -> DataFrame:
    """Add the key, a struct, on which sets of that similarity meet: one row per word of the prefix, and per slice of a common word.

    With sizes n, m and a first shared word at places i, j (rare words first), two sets share at most min(n - i, m - j)
    words. From PLACED_FROM on the asking side lists the (m, j) that can still reach the similarity; so a word that is
    common, and therefore late in the order, brings together only sets that little else tells apart.
    """
    size = F.size(words)
    place = f"{out}_at"
    rows = rows.withColumn(place, F.explode(F.sequence(F.lit(0), _prefix(size, least) - 1)))
    word = F.get(words, F.col(place))
    slices = F.ceil(word["n"] / WORD_SLICE)
    own_slice = F.pmod(F.xxhash64("pid"), slices)
    if least < PLACED_FROM:
        at = [F.lit(0).alias("size"), F.lit(0).alias("place")]
    elif not asking:
        at = [size.alias("size"), F.col(place).alias("place")]
    else:
        sizes = F.sequence(F.ceil(size * F.lit(least - _EPS)).cast("int"), F.floor(size / F.lit(least - _EPS)).cast("int"))
        met = F.flatten(F.transform(sizes, lambda m: F.transform(
            F.sequence(F.lit(0), _prefix(m, least) - 1), lambda j: F.struct(m.alias("size"), j.alias("place")))))
        can = F.filter(met, lambda x: F.least(size - F.col(place), x["size"] - x["place"]) >= (size + x["size"]) * F.lit(least / (1 + least) - _EPS))
        rows = rows.withColumn("_x", F.explode(can))
        at = [F.col("_x.size").alias("size"), F.col("_x.place").alias("place")]
    if asking:
        rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    key = F.struct(word["w"].alias("w"), *at, (F.col("_s") if asking else own_slice).alias("slice"))
    return rows.withColumn(out, key).drop("_x", "_s")


def _meet(left: DataFrame, right: DataFrame, title: float, description: float) -> DataFrame:
    """Pairs of profiles (a_, b_) whose titles, and descriptions if asked for, share what such similarities need, each pair
    at the rarest word it shares."""
    sides = []
    for rows, asking, prefix in ((left, True, "a"), (right, False, "b")):
        rows, keys = _keyed(rows, "t", title, "kt", asking), ["kt"]
        if description > 0:
            rows, keys = _keyed(rows, "d", description, "kd", asking), ["kt", "kd"]
        places = [f"{k}_at" for k in keys]
        sides.append(rows.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("pid", "tw", "dw", "t", "d", *places)]))
    met = sides[0].join(sides[1], keys).filter("a_pid <> b_pid")
    for words, k in zip(("t", "d"), keys):
        # ``slice`` and ``arrays_overlap`` look at the words before the one that the pair met at.
        before = [F.transform(F.slice(f"{p}_{words}", F.lit(1), F.col(f"{p}_{k}_at")), lambda x: x["w"]) for p in "ab"]
        met = met.filter(~F.arrays_overlap(*before))
    return met


def _profile_pairs(profiles: DataFrame, least: float) -> DataFrame:
    """a_pid, b_pid and _TEXTS: the pairs of profiles whose members can score ``least``, a profile and itself included.

    text: what the words give to the score. share: the weight of the time overlap, which a missing description raises.
    """
    two = TITLE_WEIGHT + TIME_WEIGHT
    described, bare = profiles.filter("dw IS NOT NULL"), profiles.filter("dw IS NULL")
    # The more alike two titles are, the less their descriptions need be.
    low = max(_EPS, 1 - (1 - least) / TITLE_WEIGHT)
    free = min(1.0, (least - TIME_WEIGHT) / TITLE_WEIGHT)
    steps = BANDS if low < PLACED_FROM else 1
    edges = [low + (free - low) * i / steps for i in range(steps + 1)]
    bands = [(lo, (least - TIME_WEIGHT - TITLE_WEIGHT * hi) / DESCRIPTION_WEIGHT - _EPS) for lo, hi in zip(edges, edges[1:])]
    if free < 1:
        bands.append((free, 0.0))
    found = [_meet(described, described, title, description).filter("a_pid < b_pid") for title, description in bands]
    title = 1 - (1 - least) * two / TITLE_WEIGHT
    found.append(_meet(bare, bare, title, 0).filter("a_pid < b_pid"))
    found.append(_meet(bare, described, title, 0))
    pairs = reduce(DataFrame.unionByName, [f.select("a_pid", "b_pid", "a_tw", "a_dw", "b_tw", "b_dw") for f in found])
    own = profiles.select(F.col("pid").alias("a_pid"), F.col("pid").alias("b_pid"), *[F.col(c).alias(f"{p}_{c}") for p in "ab" for c in ("tw", "dw")])
    pairs = pairs.dropDuplicates(["a_pid", "b_pid"]).unionByName(own)
    both = F.col("a_dw").isNotNull() & F.col("b_dw").isNotNull()
    t, d = F.col("score_title"), F.col("score_description")
    scored = pairs.select(
        "a_pid", "b_pid", jaccard(F.col("a_tw"), F.col("b_tw")).alias("score_title"),
        F.when(both, jaccard(F.col("a_dw"), F.col("b_dw"))).alias("score_description"),
    )
    text = F.when(d.isNotNull(), TITLE_WEIGHT * t + DESCRIPTION_WEIGHT * d).otherwise(TITLE_WEIGHT / two * t)
    share = F.when(d.isNotNull(), F.lit(TIME_WEIGHT)).otherwise(F.lit(TIME_WEIGHT / two))
    return scored.withColumns({"text": text, "share": share}).filter(F.col("text") + F.col("share") >= least - _EPS)


def _length_class() -> Column:
    """Floor of the binary logarithm of the span's length; -1 for an instant."""
    length = F.col("hi") - F.col("lo")
    return F.when(length == 0, F.lit(-1)).otherwise(F.length(F.bin(length)) - 1)


def _cells(rows: DataFrame, asking: bool) -> DataFrame:
    """Add cls, c_lo, c_hi: the grid cell of a span, or, asking, all cells in which a span with overlap ``o`` can be.

    Starts and ends of such spans differ by no more than (1/o - 1) times the shorter length, and one length is
    at most 1/o times the other. Instants only match equal instants. Without ``o`` all spans share one cell.
    """
    own, o = _length_class(), F.col("o")
    reach = F.ceil(-F.log2(o)).cast("int")
    near = F.when(own < 0, F.array(own)).otherwise(F.filter(F.sequence(own - reach, own + reach), lambda c: c >= 0)) if asking else F.array(own)
    rows = rows.withColumn("cls", F.explode(F.when(o.isNull(), F.array(F.lit(-2))).otherwise(near)))
    width = F.greatest(F.lit(1.0), F.ceil(F.pow(F.lit(2.0), F.col("cls") + 1) * (1 / o - 1 + _EPS)).cast("double"))
    for c in ("lo", "hi"):
        cell = F.floor(F.col(c) / width).cast("bigint")
        around = F.when(F.col("cls") < 0, F.array(cell)).otherwise(F.array(cell - 1, cell, cell + 1)) if asking else F.array(cell)
        rows = rows.withColumn(f"c_{c}", F.explode(F.when(o.isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(around)))
    return rows


def _score(pairs: DataFrame) -> DataFrame:
    """Pairs of members (a_, b_) with the texts' scores, as candidates with all scores; each pair is named in id order."""
    time = interval_iou(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    t, d, o, two = F.col("score_title"), F.col("score_description"), F.col("score_temporal"), TITLE_WEIGHT + TIME_WEIGHT
    combined = F.when(d.isNotNull(), TITLE_WEIGHT * t + DESCRIPTION_WEIGHT * d + TIME_WEIGHT * o).otherwise(
        (TITLE_WEIGHT / two) * t + (TIME_WEIGHT / two) * o
    )
    named = pairs.withColumn("score_temporal", time).withColumn("score_combined", clamp01(combined))
    return named.select(F.least("a_id", "b_id").alias("project_a_id"), F.greatest("a_id", "b_id").alias("project_b_id"), *_SCORES)


def _members(members: DataFrame, prefix: str) -> DataFrame:
    return members.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("pid", "id", "lo", "hi")])


def _near_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Some pairs of members that overlap well: neighbours by start among spans of like length and end. They only set a bound."""
    fields = ["a_pid", "b_pid", *_TEXTS]
    one = pairs.join(members, pairs["a_pid"] == members["pid"]).select(*fields, "id", "lo", "hi", F.lit(0).alias("side"))
    other = pairs.filter("a_pid <> b_pid").join(members, F.col("b_pid") == members["pid"]).select(*fields, "id", "lo", "hi", F.lit(1).alias("side"))
    rows = one.unionByName(other).withColumn("cls", _length_class())
    rows = rows.withColumn("cell", F.floor(F.col("hi") / F.pow(F.lit(2.0), F.greatest(F.col("cls") - 4, F.lit(0)))))
    order = Window.partitionBy("a_pid", "b_pid", "cls", "cell").orderBy("lo", "hi", "id")
    here = F.struct("id", "lo", "hi", "side")
    ahead = rows.withColumns({f"x{n}": F.lead(here, n).over(order) for n in (1, 2)})
    ahead = ahead.withColumn("x", F.explode(F.array("x1", "x2"))).filter("x IS NOT NULL")
    ahead = ahead.filter((F.col("a_pid") == F.col("b_pid")) | (F.col("side") != F.col("x.side")))
    return _score(ahead.select(*_TEXTS, *[F.col(c).alias(f"a_{c}") for c in ("id", "lo", "hi")], *[F.col(f"x.{c}").alias(f"b_{c}") for c in ("id", "lo", "hi")]))


def _expand(members: DataFrame, pairs: DataFrame, least: float, last_id: str | None = None) -> DataFrame:
    """All pairs of members that score ``least``. Members meet in time cells as narrow as the score asks of their profiles.

    With ``last_id``, pairs that score just ``least`` and whose first id comes after it are not wanted.
    """
    needed = (F.lit(least - _EPS) - F.col("text")) / F.col("share")
    o = F.array_max(F.filter(F.array(*[F.lit(x) for x in OVERLAPS]), lambda x: x <= needed))
    able = pairs.filter(F.col("text") + F.col("share") >= least - _EPS).withColumn("o", o)
    if last_id is not None:
        # Where all pairs can only score ``least``, the first id of a wanted one is small, so only such members ask.
        able = able.withColumn("tied", F.col("text") + F.col("share") <= least + _EPS)
    keys = ["a_pid", "b_pid", "cls", "c_lo", "c_hi"]
    asking = able.join(_members(members, "a"), "a_pid")
    if last_id is not None:
        asking = asking.filter(~F.col("tied") | (F.col("a_pid") != F.col("b_pid")) | (F.col("a_id") <= last_id))
    asking = _cells(asking.withColumns({"lo": F.col("a_lo"), "hi": F.col("a_hi")}), True)
    asked = _cells(able.select("a_pid", "b_pid", "o").join(_members(members, "b"), "b_pid").withColumns({"lo": F.col("b_lo"), "hi": F.col("b_hi")}), False)
    met = asking.select(*keys, *_TEXTS, "a_id", "a_lo", "a_hi").join(asked.select(*keys, "b_id", "b_lo", "b_hi"), keys)
    met = met.filter((F.col("a_pid") != F.col("b_pid")) | (F.col("a_id") < F.col("b_id")))
    found = _score(met).filter(F.col("score_combined") >= least)
    return found if last_id is None else found.filter((F.col("score_combined") > least) | (F.col("project_a_id") <= last_id))


def merge_candidates(
    projects: DataFrame,
    min_combined: float = MIN_COMBINED,
    max_pairs: int | None = MAX_PAIRS,
    max_projects: int | None = None,
) -> DataFrame:
    """The best ``max_pairs`` unordered pairs that score ``min_combined`` or more; all of them with None.

    The result is the same as scoring all pairs. The least score must be above one half, so that every pair
    shares a title word to meet on.

    Words are compared once per distinct text (a profile), not per project. For the best pairs the search goes down LEVELS; at
    each, the best of some real pairs gives a bound, and only members that can reach it are compared. It ends at
    the first level with enough pairs.
    """
    if min_combined <= 0.5:
        raise ValueError("min_combined must be above 0.5")
    if max_projects is not None:
        projects = projects.orderBy(F.desc("last_seen_at"), "id").limit(max_projects)
    words = lambda c: F.array_join(c, " ")
    profile = F.md5(F.concat(words("tw"), F.when(F.col("dw").isNull(), "").otherwise(F.concat(F.lit("|"), words("dw")))))
    features = cut_lineage(scoring_features(projects).withColumn("pid", profile))
    profiles = cut_lineage(_profiles(features))
    members = features.select("pid", "id", "lo", "hi")
    order = [F.desc("score_combined"), *_PAIR]
    if max_pairs is None:
        return _expand(members, cut_lineage(_profile_pairs(profiles, min_combined)), min_combined).orderBy(*order)
    members = cut_lineage(_first_members(members, ["pid", "lo", "hi"], max_pairs + 1))
    for level in [*[x for x in LEVELS if x > min_combined], min_combined]:
        pairs = cut_lineage(_profile_pairs(profiles, level))
        near = _near_pairs(members, pairs).filter(F.col("score_combined") >= level).orderBy(*order).limit(max_pairs)
        last = near.agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score_combined")).alias("s"), "project_a_id")).alias("last")).first()
        if last["n"] == max_pairs:
            found = _expand(members, pairs, -last["last"]["s"], last["last"]["project_a_id"])
        else:
            found = _expand(members, pairs, level)
        found = found.orderBy(*order).limit(max_pairs)
        if level == min_combined or last["n"] == max_pairs:
            return found
        found = cut_lineage(found)
        if found.count() == max_pairs:
            return found.orderBy(*order)
    raise AssertionError("the last level returns")


def recompute_candidates(
    projects: DataFrame,
    as_of: Column,
    min_combined: float = MIN_COMBINED,
    max_pairs: int | None = MAX_PAIRS,
    max_projects: int | None = None,
) -> DataFrame:
    """The candidate table, from all projects that are not archived, or from the newest ones."""
    live = projects.filter("status <> 'archived'")
    pairs = merge_candidates(live, min_combined, max_pairs, max_projects)
    return conform(pairs.withColumn("computed_at", as_of), "project_merge_candidates")


def candidate_list(candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """Candidates with both titles, neither side archived, best first."""
    live = projects.filter("status <> 'archived'")
    a = live.select(F.col("id").alias("project_a_id"), F.col("canonical_title").alias("title_a"))
    b = live.select(F.col("id").alias("project_b_id"), F.col("canonical_title").alias("title_b"))
    return candidates.join(a, "project_a_id").join(b, "project_b_id").orderBy(F.desc("score_combined"), *_PAIR)


@dataclass(frozen=True)
class MergeResult:
    projects: DataFrame
    evidence: DataFrame
    decisions: DataFrame
    candidates: DataFrame
    rejected: DataFrame


def check_merges(requests: DataFrame, decisions: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (surviving_project_id, merged_project_id, seq) with a verdict: accept, repeat or an error.

    Requests of one batch count as simultaneous: an id may not be both survivor and merged, and of several
    survivors for one project the first asked wins.
    """
    status = projects.select("id", "status")
    survivor = status.select(F.col("id").alias("surviving_project_id"), F.col("status").alias("survivor_status"))
    merged = status.select(F.col("id").alias("merged_project_id"), F.col("status").alias("merged_status"))
    prior = decisions.select("merged_project_id", F.col("surviving_project_id").alias("prior_survivor"))
    same = F.col("surviving_project_id") == F.col("merged_project_id")
    alone = (
        F.when(same, "same_project")
        .when(F.col("prior_survivor") == F.col("surviving_project_id"), "repeat")
        .when(F.col("prior_survivor").isNotNull(), "merged_elsewhere")
        .when(F.col("survivor_status").isNull() | F.col("merged_status").isNull(), "unknown_project")
        .when(F.col("survivor_status") == "archived", "survivor_archived")
        .when(F.col("merged_status") == "archived", "merged_archived")
    )
    once = requests.groupBy("surviving_project_id", "merged_project_id").agg(F.min("seq").alias("seq"))
    judged = (
        once.join(prior, "merged_project_id", "left")
        .join(survivor, "surviving_project_id", "left")
        .join(merged, "merged_project_id", "left")
        .select("surviving_project_id", "merged_project_id", "seq", alone.alias("alone"))
    )
    # Only requests that are sound by themselves can stand in each other's way.
    sound = judged.filter(F.col("alone").isNull())
    first = sound.groupBy("merged_project_id").agg(F.min_by("surviving_project_id", "seq").alias("first_survivor"))
    survivors = sound.select(F.col("surviving_project_id").alias("id")).distinct()
    both = survivors.join(sound.select(F.col("merged_project_id").alias("id")).distinct(), "id", "left_semi")
    loser = both.select(F.col("id").alias("merged_project_id"), F.lit(True).alias("loser_chained"))
    keeper = both.select(F.col("id").alias("surviving_project_id"), F.lit(True).alias("survivor_chained"))
    verdict = (
        F.when(F.col("alone").isNotNull(), F.col("alone"))
        .when(F.col("loser_chained") | F.col("survivor_chained"), "chained_in_batch")
        .when(F.col("first_survivor") != F.col("surviving_project_id"), "merged_elsewhere")
        .otherwise("accept")
    )
    return (
        judged.join(first, "merged_project_id", "left")
        .join(loser, "merged_project_id", "left")
        .join(keeper, "surviving_project_id", "left")
        .select("surviving_project_id", "merged_project_id", "seq", verdict.alias("verdict"))
    )


def apply_merges(
    requests: DataFrame,
    decisions: DataFrame,
    projects: DataFrame,
    evidence: DataFrame,
    candidates: DataFrame,
    as_of: Column,
) -> MergeResult:
    """Absorb projects into their survivors: links move, doubles go, the merged project is archived."""
    checked = cut_lineage(check_merges(requests, decisions, projects))
    accepted = checked.filter("verdict = 'accept'").select("surviving_project_id", "merged_project_id", "seq")
    gone = accepted.select(F.col("merged_project_id").alias("entity_id"), "surviving_project_id", "seq")

    place = ["session_id", *[f"_{c}" for c in ("message_id", "artifact_id", "chunk_id")]]
    keyed = evidence
    for c in ("message_id", "artifact_id", "chunk_id"):
        keyed = keyed.withColumn(f"_{c}", F.coalesce(c, F.lit("")))
    links = keyed.filter("entity_type = 'project'")
    losing = links.join(gone, "entity_id")
    # One of equal links stays: that of the earliest request, and of it the newest.
    pick = F.min_by("id", F.struct("seq", (-F.unix_micros("created_at")).alias("age"), "id"))
    moving = losing.groupBy("surviving_project_id", *place).agg(pick.alias("id"))
    target = accepted.select(F.col("surviving_project_id").alias("entity_id")).distinct()
    held = links.join(target, "entity_id", "left_semi").select(F.col("entity_id").alias("surviving_project_id"), *place)
    moving = moving.join(held.distinct(), ["surviving_project_id", *place], "left_anti").select("id", "surviving_project_id")

    lost = gone.select("entity_id", F.lit("project").alias("entity_type"))
    stay = evidence.join(lost, ["entity_id", "entity_type"], "left_anti")
    moved = evidence.join(moving, "id").withColumn("entity_id", F.col("surviving_project_id"))
    archived = accepted.select(F.col("merged_project_id").alias("id"), F.lit(True).alias("_gone"))
    touched = accepted.select(F.col("surviving_project_id").alias("id")).unionByName(archived.select("id")).distinct()
    left_over = candidates
    for c in _PAIR:
        left_over = left_over.join(touched.withColumnRenamed("id", c), c, "left_anti")
    new_decisions = accepted.withColumn("decided_at", as_of)
    return MergeResult(
        projects=conform(
            projects.join(archived, "id", "left").withColumn(
                "status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))
            ),
            "projects",
        ),
        evidence=conform(stay, "evidence_links").unionByName(conform(moved, "evidence_links")),
        decisions=conform(decisions, "project_merge_decisions").unionByName(
            conform(new_decisions, "project_merge_decisions")
        ),
        candidates=conform(left_over, "project_merge_candidates"),
        rejected=checked.filter("verdict not in ('accept', 'repeat')"),
    )


def resolve_survivor(ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add survivor_id: the project an id was merged into, one hop, else null."""
    hop = decisions.select(F.col("merged_project_id").alias("id"), F.col("surviving_project_id").alias("survivor_id"))
    return ids.join(hop, "id", "left")
