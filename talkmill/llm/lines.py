"""Line deduplication by a suffix array over line ids.

Every document is a sequence of line ids. Prefix doubling ranks the blocks of 1, 2, 4, ... lines that occur more than once:
a block of 2^k lines is the pair of ranks of its halves, and pairs are ranked in their order, so the ranks of all levels sort
the suffixes. Blocks that occur once leave the rounds, since nothing longer that starts with them is repeated.

The intervals of suffixes with a common prefix are then found from the longest blocks down. A step splits every interval by
the block that follows the common prefix. Suffixes that are not the first of their part share more lines with an earlier
one; the first ones stand for their parts in the unsplit interval, where shorter common prefixes are looked for. At the end
each line knows the longest run that starts there and also starts at an earlier line of the corpus. Runs that do not lie in
a longer one and have enough words are deleted; the first copy in order of key, file, row and line stays.

Lines are parts of the text between line feeds. Blank lines do not count and go only from within a deleted run. A run may
overlap its earlier copy, so of a line that is repeated at once one stays. Null and empty texts have no lines. Only the key and
the text are read. A line that a third of all documents share is one key of aggregates that combine before their shuffle, and
of joins whose large side Spark can split. What one document gathers is bounded by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from talkmill.llm.common import GAPS, forget, keep_possible, located, stored, without

#: Words that a run must have to be deleted.
MIN_WORDS = 50


def line_rows(rows: DataFrame) -> DataFrame:
    """key, file, row, i (number among the lines that are not blank), at (line number), h (128-bit line id), words."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    kept = F.filter(lines, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    one = rows.select("key", "file", "row", F.posexplode(kept).alias("i", "x"))
    line = F.col("x.line")
    words = F.size(F.filter(F.split(line, GAPS), lambda w: w != ""))
    return one.select(
        "key", "file", "row", "i", F.col("x.at").alias("at"),
        F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")).alias("h"), words.alias("words"),
    )


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``r``, a number that grows in the given order."""
    return stored(df.orderBy(*order).withColumn("r", F.monotonically_increasing_id()), name)


def block_levels(first: DataFrame) -> list[DataFrame]:
    """For every level k, (d, i, r): the rank of the block of 2^k lines at i, if it occurs more than once."""
    levels, half = [first], 1
    while True:
        left = levels[-1]
        right = left.select("d", (F.col("i") - half).alias("i"), F.col("r").alias("s"))
        pairs = left.join(right, ["d", "i"])
        named = pairs.groupBy("r", "s").agg(F.count("*").alias("c")).filter("c > 1").select("r", "s")
        named = ranked(named.withColumnRenamed("r", "q"), ["q", "s"], "ranks")
        if named.isEmpty():
            return levels
        level = pairs.withColumnRenamed("r", "q").join(named, ["q", "s"]).select("d", "i", "r")
        levels.append(stored(level, "level"))
        half *= 2


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(d, i, size): the lines of the longest run at i that also starts at an earlier place."""
    zero = F.lit(0).cast("bigint")
    interval = ["gd", "gi", "gl"]
    state = levels[0].select(F.lit(-1).cast("bigint").alias("gd"), zero.alias("gi"), zero.alias("gl"), "d", "i")
    found = []
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        following = levels[k].select("d", F.col("i").alias("next"), "r")
        x = stored(state.withColumn("next", F.col("i") + F.col("gl")).join(following, ["d", "next"], "left").drop("next"), "following")
        # Where no repeated block follows, there is nothing to meet on; these rows stay out of the join, whose one key they would be.
        going_on = x.filter("r IS NOT NULL")
        parts = going_on.groupBy(*interval, "r").agg(F.min(F.struct("d", "i")).alias("f"), F.count("*").alias("c"))
        met = going_on.join(parts.filter("c > 1").drop("c"), [*interval, "r"], "left")
        ended = x.filter("r IS NULL").withColumn("f", F.lit(None).cast("struct<d:bigint,i:bigint>")).select(*met.columns)
        y = stored(met.unionByName(ended), "intervals")
        forget(x)
        later = F.col("f").isNotNull() & (F.struct("d", "i") != F.col("f"))
        found.append(y.filter(later).select("d", "i", (F.col("gl") + step).alias("size")))
        if k:
            split = y.filter("f IS NOT NULL").select(
                F.col("f.d").alias("gd"), F.col("f.i").alias("gi"), (F.col("gl") + step).alias("gl"), "d", "i"
            )
            state = split.unionByName(y.filter(~later | F.col("f").isNull()).select(*interval, "d", "i"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("d", "i").agg(F.max("size").alias("size"))


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, file, row, first, last (line numbers), lines, words: the maximal runs that are later copies."""
    lines = line_rows(rows)
    common = lines.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    common = ranked(common, ["h"], "lines")
    place = stored(keep_possible(lines, F.col("h"), common, F.col("h")).join(common, "h").drop("h"), "line-rows", "zstd")
    docs = place.select("key", "file", "row").distinct().orderBy("key", "file", "row")
    docs = stored(docs.withColumn("d", F.monotonically_increasing_id()), "line-docs")
    same = [place[c].eqNullSafe(docs[c]) for c in ("key", "file", "row")]
    numbered = stored(place.join(docs, same).select("d", F.col("i").cast("bigint").alias("i"), "at", "words", "r"), "numbered")
    longest = longest_earlier(block_levels(numbered.select("d", "i", "r")))
    in_doc = Window.partitionBy("d").orderBy("i")
    sums = numbered.select("d", "i", "at", "words", F.sum("words").over(in_doc).alias("sum"))
    runs = longest.withColumn("covers", (F.lag("i").over(in_doc) == F.col("i") - 1) & (F.lag("size").over(in_doc) > F.col("size")))
    runs = runs.filter(~F.coalesce("covers", F.lit(False))).withColumn("end", F.col("i") + F.col("size") - 1)
    starts = sums.select("d", "i", F.col("at").alias("first"), (F.col("sum") - F.col("words")).alias("before"))
    ends = sums.select("d", F.col("i").alias("end"), F.col("at").alias("last"), "sum")
    whole = runs.join(starts, ["d", "i"]).join(ends, ["d", "end"]).withColumn("words", F.col("sum") - F.col("before"))
    return whole.filter(F.col("words") >= min_words).join(docs, "d").select(
        "key", "file", "row", "first", "last", F.col("size").alias("lines"), "words"
    )


def deduplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, text, n_deleted: all documents; of those with later copies of runs, the lines that stay. A null text stays null."""
    place = ["file", "row"]
    rows = located(docs.select(key, text)).select(
        F.col(key).alias("key"), F.col("__file").alias("file"), F.col("__row").alias("row"), F.col(text).cast("string").alias("text")
    )
    runs = stored(repeated_runs(rows, min_words), "runs")
    by_doc = stored(runs.groupBy(*place).agg(F.collect_list(F.struct("first", "last")).alias("cut")), "cuts")
    lines = F.split("text", "\n", -1)
    inside = lambda at: F.exists("cut", lambda c: (at >= c["first"]) & (at <= c["last"]))
    touched = keep_possible(rows, F.struct(*place), by_doc, F.struct(*place)).join(by_doc, place).withColumn("lines", lines)
    left = touched.withColumn("kept", F.filter("lines", lambda line, at: ~inside(at)))
    changed = left.select("key", F.array_join("kept", "\n").alias("text"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_deleted"))
    others = without(rows, place, by_doc).select("key", "text", F.lit(0).cast("bigint").alias("n_deleted"))
    return others.unionByName(changed).select(F.col("key").alias(key), F.col("text").alias(text), "n_deleted")
