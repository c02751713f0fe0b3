"""Chat formatting in budgeted windows.

Turns are laid end to end by the prefix sums of their tokens. The sums alone choose the windows: a turn belongs to the stride
its start falls into, and a turn that would carry its stride's window over the budget gets a window of its own, so any turn's
window is known without looking at its neighbours. Each window is led by the conversation's system turn and by as many
earlier turns as the history budget holds; what is repeated is not under the loss mask. Beside the system turn, history takes at most half of what is
left. Where a long turn has a window of its own, only as much history is put before it as the budget leaves, and the system turn
only if both fit. So a window exceeds the budget only if it is a single turn that does: a turn is never cut. A system turn of
the budget or more is not repeated.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is put into ``<|`` (and one more into
``<\\|``, and so on), which can be undone, so control strings in a text stay text. In a role, new lines and the signs of their
escape are escaped as well.

Null texts and roles count as empty. Rows without a conversation id form one conversation, and a null turn number comes first.
Rows of one turn number are ordered by role, then by a hash of the text; repeated rows are turns of their own. Only the four
named columns are read. A conversation may hold any part of all rows: its prefix sums come from blocks of turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and of the repeated history in it.
BUDGET, HISTORY = 2048, 256
#: Turn numbers whose sums are formed together.
BLOCK = 256
SYSTEM, REPEATED, NEW = range(3)


def count_tokens(text: Column) -> Column:
    """A stand-in for a tokenizer that needs no Python: words and single signs, and four for the turn's marks. A run of more than
    32 letters and digits, such as base64, counts each of them."""
    return F.regexp_count(text, F.lit(r"(?<!\w)\w{1,32}(?!\w)|\w|[^\w\s]")).cast("bigint") + 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def placed_turns(turns: DataFrame, names: tuple[str, str, str, str], tokens=count_tokens) -> DataFrame:
    """Every turn with its number, the tokens before it, and what holds for its conversation."""
    conv, turn, role, text = names
    rows = turns.select(
        F.struct(F.col(conv).alias("id")).alias("conv"), F.struct(F.floor(F.col(turn) / BLOCK).alias("no")).alias("block"),
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")))
    order = F.struct("turn", "role", F.xxhash64("text"))
    lead = F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_turns"), F.min_by(lead, order).alias("lead"),
    )
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.first("lead").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("system_tokens"),
        F.sum("block_tokens").over(whole).alias("conv_tokens"),
    )
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(blocks, ["conv", "block"]).select(
        "conv", "role", "text", "tokens", "system_tokens", "conv_tokens",
        (F.col("turns_before") + F.count("*").over(inside) - 1).alias("no"),
        (F.col("tokens_before") + F.sum("tokens").over(inside)).alias("end"),
    )
    return summed.withColumn("start", F.col("end") - F.col("tokens"))


def windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens,
) -> DataFrame:
    """conv, window (stride and part), formatted, n_context (leading turns that are repeated), loss (spans of code points
    under the mask: offset and size), tokens."""
    rows = stored(placed_turns(turns, (conv, turn, role, text), tokens), "chat-turns")
    # A system turn that fills a window by itself is not repeated and takes no room from others.
    rows = rows.withColumn("system_tokens", F.when(F.col("system_tokens") < budget, F.col("system_tokens")).otherwise(0))
    left = F.lit(budget) - F.col("system_tokens")
    rows = rows.withColumn("room", left - F.least(F.lit(history), F.floor(left / 2))).withColumn("stride", F.greatest(F.floor(F.col("room") * 3 / 4), F.lit(1)))
    at = F.floor(F.col("start") / F.col("stride"))
    over = F.col("end") > at * F.col("stride") + F.col("room")
    new = rows.withColumn("window", F.struct(at.alias("stride"), over.cast("int").alias("part")))
    spans = new.filter(F.col("conv_tokens") > F.col("stride")).groupBy("conv", "window").agg(
        F.min("start").alias("from"), (F.lit(budget) - F.sum("tokens") - F.first("system_tokens")).alias("free")
    ).filter((F.col("from") > 0) & (F.col("free") >= 0))
    # A turn is history for the windows that start within the history budget after it; they lie in few strides.
    last = F.floor((F.col("start") + history) / F.col("stride"))
    first = F.floor(F.col("end") / F.col("stride"))
    leads = (F.col("no") == 0) & (F.col("role") == "system")
    older = rows.filter((F.col("conv_tokens") > F.col("end")) & (F.col("tokens") <= history) & ~leads).select(
        "conv", "no", "role", "text", "tokens", "start", "end", F.explode(F.sequence(first, last)).alias("at")
    )
    repeated = older.join(spans.withColumn("at", F.col("window.stride")), ["conv", "at"]).filter(
        (F.col("from") >= F.col("end")) & (F.col("from") - F.col("start") <= F.least(F.lit(history), F.col("free")))
    )
    system = rows.filter(leads & (F.col("system_tokens") > 0) & (F.col("conv_tokens") > F.col("stride"))).select("conv", "no", "role", "text", "tokens")
    led = spans.join(system, "conv")
    kept = ["conv", "window", "no", "role", "text", "tokens"]
    pieces = (
        new.select(*kept, F.lit(NEW).alias("kind"))
        .unionByName(repeated.select(*kept, F.lit(REPEATED).alias("kind")))
        .unionByName(led.select(*kept, F.lit(SYSTEM).alias("kind")))
    )
    piece = F.struct("no", "kind", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("target"))
    gathered = pieces.groupBy("conv", "window").agg(F.array_sort(F.collect_list(piece)).alias("turns"), F.sum("tokens").alias("tokens"))
    shape = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    head = lambda t: F.length(t["role"]) + (len(START) + 1)
    none = F.array().cast("array<struct<at:bigint,size:bigint>>")
    zero = F.lit(0).cast("bigint")

    def add(acc: Column, t: Column) -> Column:
        body = F.length(t["text"])
        span = F.array(F.struct((acc["pos"] + head(t)).alias("at"), body.cast("bigint").alias("size")))
        return F.struct(
            (acc["pos"] + head(t) + body + (len(END) + 1)).alias("pos"),
            F.when((t["kind"] == NEW) & t["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return gathered.select(
        F.col("conv.id").alias(conv), "window", F.array_join(F.transform("turns", shape), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["kind"] != NEW)).alias("n_context"),
        F.aggregate("turns", F.struct(zero.alias("pos"), none.alias("spans")), add, lambda acc: acc["spans"]).alias("loss"), "tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with ``turns`` (role and text of those that are not repeated) and ``targets`` (texts under the mask), as they
    stand in the formatted text."""
    segments = F.split(F.col("formatted"), r"<\|im_start\|>")
    new = F.slice(segments, F.col("n_context") + 2, F.greatest(F.size(segments), F.lit(1)))
    end = len(END) + 1

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        text = F.substring(s, F.length(role) + 2, F.length(s) - F.length(role) - (1 + end))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    target = lambda s: unescape(F.substring(F.col("formatted"), (s["at"] + 1).cast("int"), s["size"].cast("int")))
    return formatted.withColumns({"turns": F.transform(new, turn), "targets": F.transform("loss", target)})
