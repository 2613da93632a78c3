"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations alone.

Lines that start with ">" are quoted; the number of those signs is their level. Neighbouring quoted
lines of one level are a passage. A message's own text (level 0, without the line that introduces a
quote) is what others can quote: its whole, its paragraphs and its lines are hashed in a normal form
(lower case, white space as one space), and of equal ones in a conversation only the earliest is kept,
so a passage that thousands repeat joins with one row. A passage is looked up whole and by its lines,
among earlier turns, and linked to the message that most of its text is from, if that is half of it.
A message answers the source of its shallowest first linked passage, or else the message before it.

A message that answers the one before it continues that one's branch; any other starts a branch, so a
branch is a run of neighbouring turns. threads() puts the runs together: the first answer to a message
continues its thread, any other starts one, and a thread's messages after all those that its first
message answers, directly or not, are a conversation in reply order. Equal rows (conversation, turn, role, text) are one message each with the same answer.

The message before is found within blocks of BLOCK turns and from block to block, so that no task
holds a whole hot conversation.

Edge cases: null text is empty; null turn or conversation: the message stays, alone, with no link and
branch null; several messages at one turn answer what is before that turn; quotes of
nothing known are removed but unlinked; a message of quotes alone has an empty text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut

#: Turns of a conversation whose order is found together.
BLOCK = 256
#: Signs before a quoted line, and a line that introduces a quote.
_QUOTED = r"^(?:[ \t]{0,3}>)+"
_INTRODUCES = r"(?i)^[^>\n]{0,300}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
MESSAGES_IN_SEGMENT = 64


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """A row for each line of the messages with quotes: id, conv_id, turn, n, level, content."""
    line = messages.select("id", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    signs = F.regexp_extract("line", _QUOTED, 0)
    rows = line.withColumn("level", F.length(F.regexp_replace(signs, "[^>]", ""))).withColumn("content", F.expr("substr(line, length(regexp_extract(line, '^(?:[ \\\\t]{0,3}>)+', 0)) + 1)"))
    after = F.lead("level").over(Window.partitionBy("id").orderBy("n"))
    introduces = (F.col("level") == 0) & F.col("line").rlike(_INTRODUCES) & (after > 0)
    return rows.withColumn("intro", F.coalesce(introduces, F.lit(False))).drop("line")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, n_linked, parent_turn, branch, pos of every row."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # id: one for equal messages; what follows is worked out once for each.
    rows = rows.withColumn("id", F.md5(F.concat_ws("\u0001", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.coalesce("role", F.lit("\u0002")), "text")))
    rows = rows.withColumn("quoting", F.col("text").rlike(r"(?m)^[ \t]{0,3}>"))
    rows = cut(rows, "messages")
    messages = rows.dropDuplicates(["id"])

    # What quoting messages say themselves, and their passages.
    lines = cut(_lines(messages.where("quoting")), "lines")
    own = lines.where("level = 0 and not intro").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("x"))  # of one message
    own = own.select("id", F.regexp_replace(F.concat_ws("\n", "x.content"), r"^\s+|\s+$", "").alias("own"))
    said = messages.join(own, "id", "left").withColumn("own", F.when(F.col("quoting"), F.coalesce("own", F.lit(""))).otherwise(F.col("text")))
    said = cut(said.select("id", "conv_id", "turn", "role", "own", "quoting"), "said")
    starts = F.when(F.col("level") == F.lag("level").over(Window.partitionBy("id").orderBy("n")), 0).otherwise(1)
    quoted = lines.withColumn("starts", starts).withColumn("passage", F.sum("starts").over(Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    quoted = quoted.where("level > 0").withColumn("form", normal("content"))
    whole = quoted.groupBy("id", "conv_id", "turn", "passage").agg(F.min("level").alias("level"), F.array_sort(F.collect_list(F.struct("n", "content"))).alias("x"))
    whole = cut(whole.withColumn("form", normal(F.concat_ws(" ", "x.content"))).where("form <> ''").drop("x"), "passages")

    # Only conversations in which something is quoted are indexed; each form of a conversation by its earliest turn.
    asked = whole.select("conv_id").distinct()
    sources = said.join(asked, "conv_id", "left_semi").where("turn is not null and own <> ''")
    forms = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n")))
    index = sources.select("conv_id", "turn", F.explode(forms).alias("form")).select("conv_id", "turn", F.xxhash64(normal("form")).alias("h"), F.length(normal("form")).alias("size")).where("size > 0")
    index = index.groupBy("conv_id", "h", "size").agg(F.min("turn").alias("source"))
    keys = whole.select("id", "conv_id", "turn", "passage", F.xxhash64("form").alias("h"), F.length("form").alias("size")).unionByName(
        quoted.where("form <> ''").select("id", "conv_id", "turn", "passage", F.xxhash64("form").alias("h"), F.length("form").alias("size"))
    )
    votes = keys.join(index, ["conv_id", "h", "size"]).where("source < turn").groupBy("id", "passage", "source").agg(F.sum("size").alias("got"))
    best = votes.groupBy("id", "passage").agg(F.max_by("source", F.struct("got", F.col("source"))).alias("source"), F.max("got").alias("got"))
    linked = whole.join(best, ["id", "passage"], "left").withColumn("source", F.when(2 * F.col("got") >= F.length("form"), F.col("source")))
    answers = linked.groupBy("id").agg(
        F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"),
        F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("level", "passage"))).alias("answers"),
    )
    said = said.join(answers, "id", "left").withColumn("n_quoted", F.coalesce("n_quoted", F.lit(0))).withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))

    # The turn before, then branches: a running maximum over a conversation's turns, by blocks.
    turns = said.where("turn is not null and conv_id is not null").groupBy("conv_id", "turn").agg(F.max("answers").alias("answers"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside, along = Window.partitionBy("conv_id", "block").orderBy("turn"), Window.partitionBy("conv_id").orderBy("block")
    ends = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last")).select("conv_id", "block", F.lag("last").over(along).alias("earlier"))
    turns = turns.join(ends, ["conv_id", "block"]).withColumn("before", F.coalesce(F.lag("turn").over(inside), "earlier")).drop("earlier")
    turns = turns.withColumn("parent_turn", F.coalesce("answers", "before"))
    turns = turns.withColumn("start", F.when(F.col("before").isNull() | (F.col("parent_turn") != F.col("before")), F.col("turn")))
    turns = cut(turns, "turns")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    heads = turns.groupBy("conv_id", "block").agg(F.max("start").alias("m"), F.count("*").alias("c"))
    heads = heads.select("conv_id", "block", F.max("m").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("above"), F.coalesce(F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    turns = turns.join(heads, ["conv_id", "block"]).withColumn("branch", F.coalesce(F.max("start").over(upto), "above")).withColumn("k", F.row_number().over(inside) + F.col("ahead"))
    first = turns.where("branch = turn").select("conv_id", "branch", F.col("k").alias("k0"))
    turns = turns.join(first, ["conv_id", "branch"]).select("conv_id", "turn", "parent_turn", "branch", (F.col("k") - F.col("k0")).alias("pos"))
    each = said.select("id", "own", "n_quoted", "n_linked")
    return (
        rows.select("id", "conv_id", "turn", "role").join(each, "id").join(turns, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted", "n_linked", "parent_turn", "branch", F.col("pos").cast("long").alias("pos"))
    )


def chats(linked: DataFrame) -> DataFrame:
    """conv_id, branch, segment, n_messages, text: branches as chat text, in segments of at most
    MESSAGES_IN_SEGMENT places, so that a row is bounded however long a conversation gets."""
    segment = F.floor(F.col("pos") / MESSAGES_IN_SEGMENT)
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    rows = linked.where("branch is not null").select("conv_id", "branch", segment.alias("segment"), "pos", "turn", said.alias("said")).distinct()
    grouped = rows.groupBy("conv_id", "branch", "segment").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("x"))
    return grouped.select("conv_id", "branch", "segment", "n_messages", F.concat_ws("", "x.said").alias("text"))


def _threads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, thread, place of every turn (conv_id, turn, parent_turn, branch, pos), and conv_id,
    thread, above, upto: the threads that stand above each one, and how many of their places do."""
    runs = turns.groupBy("conv_id", "branch").agg(F.count("*").alias("size"), F.min_by("parent_turn", "pos").alias("parent"))
    at = turns.select("conv_id", F.col("turn").alias("parent"), F.col("branch").alias("up"), F.col("pos").alias("k"))
    sizes = runs.select("conv_id", F.col("branch").alias("up"), F.col("size").alias("up_size"))
    runs = cut(runs.join(at, ["conv_id", "parent"], "left").join(sizes, ["conv_id", "up"], "left"), "runs")
    # The end of a run has its first answer in the first run that starts from it.
    first = runs.where("k = up_size - 1").groupBy("conv_id", "parent").agg(F.min("branch").alias("branch")).withColumn("goes_on", F.lit(True))
    runs = cut(runs.join(first, ["conv_id", "parent", "branch"], "left"), "runs")
    heads = runs.select("conv_id", "branch", F.when(F.col("goes_on"), F.col("up")).otherwise(F.col("branch")).alias("head"), F.when(F.col("goes_on"), F.col("up_size")).otherwise(F.lit(0)).alias("ahead"))
    while True:  # paths double in each round
        heads = cut(heads, "heads")
        above = heads.select("conv_id", F.col("branch").alias("head"), F.col("head").alias("top"), F.col("ahead").alias("more"))
        if heads.join(above, ["conv_id", "head"]).where("top <> head").isEmpty():
            break
        heads = heads.join(above, ["conv_id", "head"]).select("conv_id", "branch", F.col("top").alias("head"), (F.col("ahead") + F.col("more")).alias("ahead"))
    places = turns.join(heads, ["conv_id", "branch"]).select("conv_id", "turn", F.col("head").alias("thread"), (F.col("pos") + F.col("ahead")).alias("place"))
    places = cut(places, "places")
    starts = runs.where("goes_on is null and parent is not null").select("conv_id", F.col("branch").alias("thread"), F.col("parent").alias("turn"))
    jump = starts.join(places.select("conv_id", "turn", F.col("thread").alias("above"), (F.col("place") + 1).alias("upto")), ["conv_id", "turn"]).select("conv_id", "thread", "above", "upto")
    paths = jump = cut(jump, "paths")
    while True:
        over = jump.select("conv_id", "thread", F.col("above").alias("mid"))
        onward = lambda x: over.join(x.withColumnRenamed("thread", "mid"), ["conv_id", "mid"]).select("conv_id", "thread", "above", "upto")  # noqa: B023, E731
        more, jump = cut(onward(paths), "paths"), cut(onward(jump), "jumps")
        if more.isEmpty():
            return places, paths
        paths = paths.unionByName(more)


def threads(linked: DataFrame) -> DataFrame:
    """conv_id, thread, segment, n_messages, n_above, text: a conversation in reply order for each thread,
    all that it answers first (n_above of the messages), in segments of at most MESSAGES_IN_SEGMENT
    places. A message without turn or conversation is a conversation of its own, with thread null."""
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    linked = cut(linked.select("conv_id", "turn", "parent_turn", "branch", "pos", said.alias("said")).distinct(), "linked")
    places, paths = _threads(linked.where("branch is not null").select("conv_id", "turn", "parent_turn", "branch", "pos").distinct())
    depth = cut(paths.groupBy("conv_id", "thread").agg(F.sum("upto").alias("depth")), "depth")
    placed = places.join(depth, ["conv_id", "thread"], "left").withColumn("at", F.coalesce("depth", F.lit(0)) + F.col("place"))
    placed = cut(placed.select("conv_id", "turn", "thread", "place", "at"), "placed")
    above = paths.join(placed.withColumnRenamed("thread", "above"), ["conv_id", "above"]).where("place < upto")
    rows = placed.select("conv_id", "thread", "turn", "at", F.lit(0).alias("over")).unionByName(above.select("conv_id", "thread", "turn", "at", F.lit(1).alias("over")))
    rows = rows.join(linked.where("branch is not null").select("conv_id", "turn", "said"), ["conv_id", "turn"]).withColumn("segment", F.floor(F.col("at") / MESSAGES_IN_SEGMENT))
    grouped = rows.groupBy("conv_id", "thread", "segment").agg(F.count("*").alias("n_messages"), F.sum("over").alias("n_above"), F.array_sort(F.collect_list(F.struct("at", "said"))).alias("x"))
    alone = linked.where("branch is null").select(
        "conv_id", F.lit(None).cast("long").alias("thread"), F.lit(0).cast("long").alias("segment"), F.lit(1).cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_above"), F.col("said").alias("text")
    )
    return grouped.select("conv_id", "thread", "segment", "n_messages", "n_above", F.concat_ws("", "x.said").alias("text")).unionByName(alone)
