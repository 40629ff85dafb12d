"""Quotation linking: who answers whom, from quoted passages, and conversations without the quotes.

Lines that start with ``>`` are quoted; the number of such marks is their level. A passage is a run of quoted lines of one
level in a message. Passages, and their single lines, are normalised (lower case, single spaces) and hashed, and so
are the own words of every message: the whole, its paragraphs and its lines. A passage belongs to the
earliest message of its conversation with the same hash, if that is earlier than the quoting one. A message
answers the message that most of its outermost linked passages come from, by characters, the later one in a tie;
without a link it answers the message before it.

The first answer to a message continues its branch, any other opens a new one. Along a branch every message answers
the one before it, so (branch, position) orders a conversation by reply. Turns in a row that each answer the one before
are a run, found by windows; pointer jumping joins runs to branches, in log2(runs) rounds. Only DataFrame functions
are used.

Null text is empty; null conversation and turn are one value each, below all others. Rows with equal conversation and
turn are one message with several texts: they share parent, branch and position. Quoted text without an original is
dropped like all quotes. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscape.llm.common import NO_ID, stored

QUOTED = r"^[ \t]*>"
MARKS = r"^(?:[ \t]*>)+"
#: Turns of a conversation that one task orders, and messages of one row of ``as_conversations``.
BLOCK = 1024
SEGMENT = 256


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def own_text(text: Column) -> Column:
    """The text without its quoted lines and without empty lines at its ends."""
    kept = F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(QUOTED)), "\n")
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def _messages(table: DataFrame) -> DataFrame:
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    return table.select(key("conv_id").alias("conv"), key("turn").alias("turn"), "role", "text")


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, size, line) of every quoted line, with its passage's hash and size."""
    row = F.xxhash64("role", "text").alias("row")
    lines = messages.where(F.col("text").rlike(r"(?m)" + QUOTED)).distinct().select(
        "conv", "turn", row, F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    level = _level(F.col("line"))
    body = _normal(F.regexp_replace("line", MARKS, ""))
    quoted = lines.where(level > 0).select("conv", "turn", "row", "pos", level.alias("level"), body.alias("body"))
    # Lines of one level next to each other have one difference; a window holds one message.
    order = Window.partitionBy("conv", "turn", "row", "level").orderBy("pos")
    runs = quoted.withColumn("run", F.col("pos") - F.row_number().over(order))
    whole = F.array_sort(F.collect_list(F.struct("pos", "body")))
    passages = runs.groupBy("conv", "turn", "row", "level", "run").agg(whole.alias("lines"))
    bodies = F.filter(F.transform("lines", lambda x: x["body"]), lambda x: x != "")
    return passages.select("conv", "turn", "level", bodies.alias("bodies")).where(F.size("bodies") > 0)


def _hashes(passages: DataFrame) -> DataFrame:
    """A row per passage and per line of it; ``whole`` tells which."""
    joined = F.array_join("bodies", " ")
    entry = lambda text, whole: F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("size"), F.lit(whole).alias("whole"))
    both = F.concat(F.array(entry(joined, True)), F.transform("bodies", lambda b: entry(b, False)))
    return passages.select("conv", "turn", "level", F.explode(both).alias("e")).select("conv", "turn", "level", "e.*")


def originals(messages: DataFrame) -> DataFrame:
    """(conv, hash, origin): the earliest turn whose own words have the hash."""
    own = own_text(F.col("text"))
    parts = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    hashes = F.transform(F.filter(F.transform(parts, _normal), lambda x: x != ""), lambda x: F.xxhash64(x))
    rows = messages.select("conv", "turn", F.explode(F.array_distinct(hashes)).alias("hash"))
    return rows.groupBy("conv", "hash").agg(F.min("turn").alias("origin"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the message that the quotes of a message point to."""
    asked = _hashes(quoted_passages(messages))
    found = asked.join(originals(messages), ["conv", "hash"]).where("origin < turn")
    # A whole passage counts twice as much as its lines, which it holds as well.
    votes = found.groupBy("conv", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = F.max(F.struct(-F.col("level"), "size", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("best")).select("conv", "turn", F.col("best.origin").alias("parent"))


def previous_turns(nodes: DataFrame) -> DataFrame:
    """(conv, turn, before): the turn before it. Turns are ordered in blocks, so that a conversation
    of any length is split over tasks; the first of a block follows the last of the block before."""
    block = F.floor(F.col("turn") / BLOCK)
    rows = nodes.withColumn("block", block)
    inside = Window.partitionBy("conv", "block").orderBy("turn")
    ends = rows.groupBy("conv", "block").agg(F.max("turn").alias("end"))
    along = Window.partitionBy("conv").orderBy("block")
    ends = ends.select("conv", "block", F.lag("end").over(along).alias("end"))
    ordered = rows.withColumn("lag", F.lag("turn").over(inside))
    return ordered.join(ends, ["conv", "block"]).select("conv", "turn", F.coalesce("lag", "end").alias("before"))


def _runs(nodes: DataFrame, on: DataFrame) -> DataFrame:
    """(conv, turn, up, head, step): turns in a row that each continue the branch of the turn before are a run,
    within a block; ``head`` is its first turn and ``step`` the distance from it."""
    rows = nodes.join(on, ["conv", "turn"], "left").withColumn("block", F.floor(F.col("turn") / BLOCK))
    along = Window.partitionBy("conv", "block").orderBy("turn")
    rows = rows.withColumn("at", F.row_number().over(along))
    starts = F.col("up").isNull() | (F.col("up") != F.col("before")) | (F.col("at") == 1)
    rows = rows.withColumn("begin", F.max(F.when(starts, F.struct("at", "turn"))).over(along))
    step = (F.col("at") - F.col("begin.at")).cast("long")
    return rows.select("conv", "turn", "up", F.col("begin.turn").alias("head"), step.alias("step"))


def branches(nodes: DataFrame) -> DataFrame:
    """(conv, turn, branch, position) of ``nodes(conv, turn, parent, before)``.

    Pointers jump from run to run, and a run that has reached the start of its branch jumps no more."""
    first = nodes.where("parent is not null").groupBy("conv", "parent").agg(F.min("turn").alias("turn"))
    on = first.select("conv", "turn", F.col("parent").alias("up"))
    rows = stored(_runs(nodes, on), "quote-runs")
    heads = rows.where("turn = head")
    ends = rows.select("conv", F.col("turn").alias("up"), F.col("head").alias("top"), (F.col("step") + 1).alias("far"))
    roots = heads.where("up is null").select("conv", "turn", F.col("turn").alias("top"), F.lit(0).cast("long").alias("far"))
    moving = stored(heads.select("conv", "turn", "up").join(ends, ["conv", "up"]).select("conv", "turn", "top", "far"), "quote-branches")
    settled = stored(roots, "quote-settled")
    while moving.limit(1).count():
        ahead = settled.withColumn("more", F.lit(False)).union(moving.withColumn("more", F.lit(True)))
        ahead = ahead.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("far").alias("on"), "more")
        moved = moving.join(ahead, ["conv", "top"]).select(
            "conv", "turn", F.col("next").alias("top"), (F.col("far") + F.col("on")).alias("far"), "more"
        )
        moved = stored(moved, "quote-branches")
        settled = settled.union(moved.where("not more").drop("more"))
        moving = moved.where("more").drop("more")
    tops = settled.select("conv", F.col("turn").alias("head"), "top", "far")
    return rows.join(tops, ["conv", "head"]).select(
        "conv", "turn", F.col("top").alias("branch"), (F.col("far") + F.col("step")).alias("position")
    )


def link_quotes(table: DataFrame) -> DataFrame:
    """One row per row of ``table(conv_id, turn, role, text)``: conv_id, turn, role, parent_turn, quoted (whether a
    quote gave the parent), branch_turn, position, n_quoted (quoted lines) and text without quotes."""
    messages = _messages(table)
    nodes = messages.select("conv", "turn").distinct()
    links = quote_links(messages)
    parents = previous_turns(nodes).join(links, ["conv", "turn"], "left")
    parents = stored(
        parents.select("conv", "turn", "before", F.coalesce("parent", "before").alias("parent"), F.col("parent").isNotNull().alias("quoted")),
        "quote-parents",
    )
    placed = parents.join(branches(parents.select("conv", "turn", "parent", "before")), ["conv", "turn"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    n_quoted = F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(QUOTED))).cast("long")
    return messages.join(placed, ["conv", "turn"]).select(
        real("conv").alias("conv_id"),
        real("turn").alias("turn"),
        "role",
        real("parent").alias("parent_turn"),
        "quoted",
        real("branch").alias("branch_turn"),
        "position",
        n_quoted.alias("n_quoted"),
        own_text(F.col("text")).alias("text"),
    )


def as_conversations(linked: DataFrame) -> DataFrame:
    """Branches as lists of (position, role, text), ``SEGMENT`` messages a row."""
    segment = F.floor(F.col("position") / SEGMENT)
    message = F.struct("position", "role", "text")
    return linked.groupBy("conv_id", "branch_turn", segment.alias("segment")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
