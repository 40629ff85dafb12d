"""Mix sources to target weights with Efraimidis-Spirakis sampling.

Every source has a weight; the targets share the words of the whole corpus by weight, but no source gives
more than ``epochs`` times its own words, and what it can't give goes to the others by weight.
A source whose target is k times its words and a rest gives k complete epochs first; the rest is a
fractional epoch: documents get the key -ln(u) / w, u uniform from a hash of the id, w the document's
quality weight, are sorted by it within their source, and the running sum of their words is cut at
the rest. The document on the border comes in where that brings the sum nearer to the target, so a source
misses its target by half a document at most.

No source is sorted in one task. Keys become ordered integers; their leading bits give a histogram of
words per source, the bin that the rest falls into is split again by the next bits, and only the
documents of the last bin are ranked. What comes out is one cut per source, which every row is compared
with where it lies: texts don't move.

Null text has no words and is never taken; a null source is one source, the last. Null or non-positive
weights count as ``DEFAULT_WEIGHT``. Rows of equal id and size share their fate; null ids are equal. An empty
table gives an empty mix. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscape.llm.common import NO_ID, fresh, stored, words
from corpuscape.runtime import broadcast_if_small

#: Fixed cycle of source weights.
CYCLE = (1, 2, 3)
EPOCHS = 3
DEFAULT_WEIGHT = 0.5
#: Bits of a key; those that one histogram resolves, and histograms before the rest is ranked.
KEY_BITS = 48
BITS = 12
ROUNDS = 3


def exponential_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / w; the smallest keys are a weighted sample without replacement."""
    text = F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    uniform = (draw + 0.5) / float(2**48)
    sound = F.when(weight > 0, weight).otherwise(DEFAULT_WEIGHT).cast("double")
    return -F.ln(uniform) / sound


def key_code(key: Column) -> Column:
    """The key as an integer of ``KEY_BITS`` bits in the same order."""
    return F.floor(key / (key + 1) * float(2**KEY_BITS)).cast("long")


def plain_share(text: Column) -> Column:
    """Quality weight of a text, 0 to 1: low where symbols are many for its words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(words(text) > 0, words(text) / (words(text) + 4 * symbols)).otherwise(0.0)


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sized(source, size)``.

    Sources reach their cap in the order of cap over weight, so the capped ones are a prefix of that
    order: a source is capped if what is left for it and those behind it asks more of it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (place % len(CYCLE) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * EPOCHS)
    # One row per source from here on.
    ratio = F.col("cap") / F.col("weight")
    upward = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / heavy).withColumn("capped", F.col("level") > ratio)
    # Behind the first source that isn't capped the levels only fall.
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return levels.select("source", "source_size", target.alias("target"))


def source_cuts(draws: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, low, last) of ``draws(source, id, size, code)``: a
    document belongs to the fractional epoch if its code is under ``low`` or its (code, id, size)
    is ``last`` or less."""
    targets = source_targets(draws.select("source", "size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    zero = F.lit(0).cast("long")
    border = stored(
        targets.withColumn("epochs", epochs.cast("long")).withColumns(
            {"rest": rest, "low": zero, "before": zero}
        ),
        "mix-targets",
    )
    sources = border.count()
    small = lambda df: broadcast_if_small(df, rows=sources, row_bytes=200)
    same = F.col("d.source").eqNullSafe(F.col("b.source"))

    def open_rows(width: int) -> DataFrame:
        inside = (F.col("d.code") >= F.col("b.low")) & (F.col("d.code") < F.col("b.low") + F.lit(width))
        return draws.alias("d").join(small(border).alias("b"), same & inside)

    width = 2**KEY_BITS
    for _ in range(ROUNDS):
        step = width >> BITS
        bin_of = F.floor((F.col("d.code") - F.col("b.low")) / step)
        bins = (
            open_rows(width)
            .groupBy("b.source", "b.before", "b.rest", bin_of.alias("bin"))
            .agg(F.sum("d.size").alias("words"))
        )
        sums = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        # The rest is less than the source, so the sum of some bin passes it.
        passed = (
            sums.where(F.col("before") + F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bin", "upto", "words")).alias("first"))
        )
        moved = border.alias("b").join(small(passed).alias("d"), same, "left")
        low = F.col("b.low") + F.coalesce(F.col("first.bin"), zero) * step
        before = F.col("b.before") + F.coalesce(F.col("first.upto") - F.col("first.words"), zero)
        kept = [F.col(f"b.{c}") for c in ("source", "source_size", "target", "epochs", "rest")]
        border = stored(moved.select(*kept, low.alias("low"), before.alias("before")), "mix-border")
        width = step
    group = ["source", "before", "rest", "code", "id", "size"]
    rows = open_rows(width).select("b.source", "b.before", "b.rest", "d.code", "d.id", "d.size")
    ties = rows.groupBy(*group).agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("code", "id", "size")
    upto = F.sum("words").over(along)
    last = (
        ties.withColumn("upto", upto)
        .where(F.col("before") + F.col("upto") - F.col("words") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("code", "id", "size")).alias("last"))
    )
    return border.alias("b").join(small(last).alias("d"), same, "left").select(
        "b.source", "source_size", "target", "epochs", "low", "last"
    )


def mix(docs: DataFrame, weight: Column, seed: int = 0, into: str = "mix") -> DataFrame:
    """``docs`` with a struct ``into`` of size, source_size, target, copies and taken: how many times the
    mix takes the document, and the words that makes. ``docs`` has doc_id, text and source."""
    code = key_code(exponential_key(F.col("doc_id"), weight, seed))
    own = F.struct(
        code.alias("code"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        words(F.col("text")).alias("size"),
    )
    draws = stored(docs.select("source", own.alias("own")).select("source", "own.*"), "mix-draws")
    cuts = stored(source_cuts(draws), "mix-cuts")
    few = broadcast_if_small(cuts, rows=cuts.count(), row_bytes=200)
    mine = fresh(docs, "own")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    inside = (F.col(f"{mine}.code") < F.col("c.low")) | F.coalesce(F.col(mine) <= F.col("c.last"), F.lit(False))
    copies = F.when(F.col(f"{mine}.size") > 0, F.col("c.epochs") + inside.cast("long")).otherwise(0)
    found = F.struct(
        F.col(f"{mine}.size").alias("size"),
        F.col("c.source_size").alias("source_size"),
        F.col("c.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col(f"{mine}.size")).alias("taken"),
    )
    return (
        docs.withColumn(mine, own)
        .alias("d")
        .join(few.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
        .select(*columns, found.alias(into))
    )


def mixed(docs: DataFrame, weight: Column, seed: int = 0) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, columns as they were."""
    into = fresh(docs, "mix")
    rows = mix(docs, weight, seed, into).where(F.col(f"{into}.copies") > 0)
    repeats = F.sequence(F.lit(1).cast("long"), F.col(f"{into}.copies"))
    return rows.withColumn(into, F.explode(repeats)).drop(into)
