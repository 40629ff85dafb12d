"""Near duplicates by HyperMinHash sketches, bands of registers and exact confirmation.

A document's set holds its distinct shingles of words, lower-cased in A-Z. Equal sets form a class, and
one document of each class goes on. Its sketch has ``REGISTERS`` buckets; each keeps the smallest hash
that falls into it as leading zeros and ``MANTISSA`` bits of what follows, 16 bits in all. Empty buckets borrow from
others in a fixed random order, so that small sets fill the sketch as well. ``BAND`` registers next to each other
are a band; classes that share a band are candidates. At a similarity of 0.8 a pair shares none of the 32 bands
with a probability of 5e-8.

Families of thousands of near copies share their bands, and their pairs are not listed. Each member is compared
with one pivot, the member whose bands are shared most, then with the next of its bands' pivots that is not in its component
yet, and after ``SINGLE_ROUNDS`` such rounds with all that are left.
Comparing means: the estimate from the registers, corrected for accidental equality, must not rule the pair
out, and the full sets decide. Most of a family is then one component, and pairs within it can't
change it. What is left outside, though it shares a band, meets all other members of its family by full sets, in blocks of
``BLOCK`` by ``BLOCK`` documents: a task holds one block of each side, looks shingles up in an index of the
strays and returns one link for each two components, so no pairs are made as rows.

Null, empty or wordless text has an empty set and is linked with nothing. A text of fewer words than
a shingle is one shingle. Rows of equal id are one document with each of its texts; null ids are one id
below all others. Empty tables give empty results. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import NO_ID, byte_values, fresh, stored
from corpuscape.runtime import broadcast_if_small, small_batches

REGISTERS = 128
BAND = 4
MANTISSA = 10
PERCENT = 80
#: Estimates under this can't belong to a pair of PERCENT: more than eight standard deviations off.
LEAST_ESTIMATE = 0.5
#: Copies of one text from which on their rows don't move to learn their component.
MANY_COPIES = 200
#: Sets of fewer shingles are confirmed without an estimate.
SMALL_SET = 64
BLOCK = 256
#: Rounds in which a document meets one pivot, before all that are left.
SINGLE_ROUNDS = 3
EMPTY = np.uint16(0xFFFF)

_BITS = REGISTERS.bit_length() - 1
_BORDERS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS)
#: The order in which an empty bucket looks for one to borrow from.
_PROBES = np.random.default_rng(5).integers(0, REGISTERS, (64, REGISTERS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of 64 bits."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    rows = len(words) - width + 1
    sums = np.full(rows, width, np.uint64)
    for i in range(width):
        sums = _mix(sums * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + rows])
    return np.unique(sums)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` 16-bit registers per set."""
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for row, (hashes, low) in enumerate(zip(sets, least)):
        if len(hashes):
            # Sorted hashes are sorted by bucket, and the first of a bucket is its smallest.
            at = np.minimum(np.searchsorted(hashes, _BORDERS), len(hashes) - 1)
            low[:] = hashes[at]
            full[row] = low >= _BORDERS
            full[row, :-1] &= low[:-1] < _BORDERS[1:]
    rest = least << np.uint64(_BITS)
    length = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = (53 - length).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    found = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    found[~full] = EMPTY
    lacking = np.flatnonzero(full.any(1) & ~full.all(1))
    source, have = found[lacking], full[lacking]
    filled, done = source.copy(), have.copy()
    for probe in _PROBES:
        take = ~done & have[:, probe]
        filled[take] = source[:, probe][take]
        done |= take
    for shift in range(1, REGISTERS):
        if done.all():
            break
        take = ~done & np.roll(have, -shift, 1)
        filled[take] = np.roll(source, -shift, 1)[take]
        done |= take
    found[lacking] = filled
    return found


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, corrected for registers equal by accident: two
    unrelated minima agree in leading zeros for a third of all cases, then in the mantissa."""
    accident = 2.0**-MANTISSA / 3
    return ((a == b).mean(1) - accident) / (1 - accident)


SKETCH = "id long, n_shingles long, set_hash binary, bands array<long>"


def _sketcher(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                sets = [shingle_set(x, size) for x in byte_values(piece.column("text"))]
                bands = registers(sets).view(np.int64)
                width = bands.shape[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), pa.array(bands.ravel())
                )
                hashes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["id", "n_shingles", "set_hash", "bands"])

    return sketch


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (
                batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint16) for c in ("bands_a", "bands_b")
            )
            keep = estimate(a, b) >= LEAST_ESTIMATE
            few = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) < SMALL_SET
            yield batch.select(["a", "b"]).filter(pa.array(keep | few))


def _confirmer(size: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last = [], (None, None)
            texts = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            for x, y in zip(*texts):
                if last[0] != y:  # pivots come in runs
                    last = y, shingle_set(y.encode(), size)
                s, t = shingle_set(x.encode(), size), last[1]
                common = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(100 * common >= PERCENT * (len(s) + len(t) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return confirm


def confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: sketches.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")
    )
    ratio = (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(ratio)
    likely = stored(likely.mapInArrow(_estimated, "a long, b long").distinct(), "near-likely")
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    # Many pairs have one pivot, so b's texts are few: they go first.
    pivots = text("b").join(likely.select("b").distinct(), "b", "left_semi")
    both = likely.join(pivots, "b").join(text("a"), "a")
    # A pivot's text comes with each of its pairs.
    with small_batches(texts.sparkSession):
        return stored(both.mapInArrow(_confirmer(size), "a long, b long").distinct(), "near-links")


def component_labels(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that the links reach, for every linked id."""
    edges = stored(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "near-edges"
    )
    labels = stored(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "near-labels")
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels.id == near.u).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        lower = stored(lower, "near-lower")
        # Follow the label of the label: chains halve.
        ahead = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = lower.join(ahead, "label", "left").select("id", F.least("label", "further").alias("label"), "was")
        moved = stored(moved, "near-labels")
        changed = moved.where("label < was").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels


def _index_blocks(size: int):
    """One cell of blocks: links between strays and members of other components."""

    def compare(cell: pa.Table) -> pa.Table:
        rows = cell.select(["id", "label", "stray"]).to_pylist()
        sets = [shingle_set(x, size) for x in byte_values(cell.column("text"))]
        strays = [i for i, r in enumerate(rows) if r["stray"]]
        members = [i for i, r in enumerate(rows) if not r["stray"]]
        links: dict[tuple[int, int], tuple[int, int]] = {}
        if strays and members:
            hashes = np.concatenate([sets[i] for i in strays])
            sizes = np.array([len(sets[i]) for i in strays])
            owner = np.repeat(np.arange(len(strays)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            for i in members:
                own = sets[i]
                low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                count = high - low
                at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                common = np.bincount(owner[at], minlength=len(strays))
                near = (100 * common >= PERCENT * (sizes + len(own) - common)) & (common > 0)
                for s in np.flatnonzero(near).tolist():
                    a, b = rows[strays[s]], rows[i]
                    if a["label"] != b["label"]:
                        links.setdefault((a["label"], b["label"]), (a["id"], b["id"]))
        found = list(links.values())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return compare


def pivot_edges(open_rows: DataFrame, faced: DataFrame) -> DataFrame:
    """(id, pivot, other) of open rows: the first pivot of a row, itself if it has none above it, with each other one
    and with itself. Families are components of pivots, far fewer than rows."""
    ids = open_rows.select("id").distinct()
    above = faced.join(ids, "id", "left_semi").select("id", (-F.col("pivot.turned")).alias("other"), "pivot")
    firsts = above.groupBy("id").agg(F.max_by("other", "pivot").alias("pivot"))
    firsts = stored(ids.join(firsts, "id", "left").select("id", F.coalesce("pivot", "id").alias("pivot")), "near-firsts")
    heads = firsts.select(F.col("pivot").alias("id")).distinct()
    pivots = above.select(F.col("other").alias("id")).union(heads).distinct()
    own = firsts.join(pivots, "id", "left_semi").select("id", F.col("id").alias("other"))
    return stored(firsts.join(above.select("id", "other").union(own), "id").select("id", "pivot", "other"), "near-pivots")


def stray_links(open_rows: DataFrame, pivots: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between components of one family. ``open_rows(id, label)`` are members of bands that hold more
    than one component, ``pivots(id, pivot, other)`` join those of one family."""
    edges = pivots.select(F.col("pivot").alias("a"), F.col("other").alias("b")).distinct()
    families = component_labels(edges.union(edges.select("b", "b"))).withColumnRenamed("id", "pivot").withColumnRenamed("label", "family")
    named = pivots.select("id", "pivot").distinct().join(families, "pivot").select("id", "family")
    members = stored(open_rows.join(named, "id"), "near-families")
    parts = members.groupBy("family", "label").count()
    main = parts.groupBy("family").agg(
        F.max(F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    strays = F.col("all") - F.col("most")
    plan = main.select(
        "family", F.col("main.label").alias("main"), blocks(strays).alias("ns"), blocks(F.col("all")).alias("nm")
    ).where("ns > 0")
    rows = members.join(plan, "family").withColumn("h", F.xxhash64("id"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    narrow = lambda sb, mb, stray: rows.where("label <> main" if stray else "true").select(
        "family", "id", "label", F.lit(stray).alias("stray"), sb.alias("sb"), mb.alias("mb")
    )
    cells = narrow(every("ns"), F.pmod("h", F.col("nm")), False).union(narrow(F.pmod("h", F.col("ns")), every("nm"), True))
    full = cells.join(texts, "id")
    return full.groupBy("family", "sb", "mb").applyInArrow(_index_blocks(size), "a long, b long")


def find_components(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, component) of ``docs(doc_id, text)``, a row per row; ids as ``doc_key``."""
    texts = docs.select(doc_key(F.col("doc_id")).alias("id"), "text")
    with small_batches(texts.sparkSession):
        rows = stored(texts.mapInArrow(_sketcher(size), SKETCH), "near-sketches")
    full = rows.where("n_shingles > 0")
    # Exact copies become one row before they move.
    first = F.min_by(F.struct("n_shingles", "bands"), "id").alias("own")
    classes = stored(full.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("n"), first), "near-classes")
    reps = classes.select(F.col("rep").alias("id"), "own.n_shingles", "own.bands")
    # Band and key in one number; two that meet by accident are compared for nothing.
    keyed = reps.select("id", F.posexplode("bands").alias("band", "registers"))
    bands = keyed.select(F.xxhash64("band", "registers").alias("key"), "id")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(shared, "key"), "near-members")
    ranks = stored(members.groupBy("id").agg(F.sum("n").alias("rank")), "near-ranks")
    near_ids = broadcast_if_small(ranks.select("id"), rows=ranks.count(), row_bytes=40)
    # The largest rank first, then the smallest id.
    place = F.struct("rank", (-F.col("id")).alias("turned"))
    members = stored(members.join(ranks, "id").select("key", "id", place.alias("place")), "near-members")
    sketches = stored(reps.join(near_ids, "id", "left_semi"), "near-reps")
    texts = stored(texts.join(near_ids, "id", "left_semi"), "near-texts")
    pivots = members.groupBy("key").agg(F.max("place").alias("pivot"))
    faced = stored(members.join(pivots, "key").where("place < pivot").select("id", "pivot").distinct(), "near-faced")
    pair = [F.col("id").alias("a"), (-F.col("pivot.turned")).alias("b")]
    labels, left = None, faced

    def labelled(pairs: DataFrame) -> DataFrame:
        """Without pairs of one component; what no link reaches is one by itself."""
        pairs = pairs.withColumn("b", -F.col("pivot.turned"))
        for x in ("id", "b"):
            own = labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"))
            pairs = pairs.join(own, x, "left").withColumn(f"label_{x}", F.coalesce(f"label_{x}", x))
        return pairs.where("label_id <> label_b").select("id", "pivot")

    def merged(links: DataFrame) -> DataFrame:
        """Components after these links; those before count as a star each."""
        return component_labels(links if labels is None else links.union(labels.where("id <> label").select("id", "label")))

    for _ in range(SINGLE_ROUNDS):
        first = left.groupBy("id").agg(F.max("pivot").alias("pivot"))
        labels = merged(confirmed(first.select(*pair), sketches, texts, size))
        left = stored(labelled(left.join(first, ["id", "pivot"], "left_anti")), "near-left")
    labels = merged(confirmed(left.select(*pair), sketches, texts, size))
    own = labels.withColumnRenamed("id", "member")
    parted = members.join(own, members.id == own.member, "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    parts = parted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_rows = stored(parted.join(parts.select("key"), "key", "left_semi").select("id", "label").distinct(), "near-open")
    last = stray_links(open_rows, pivot_edges(open_rows, faced), texts, size)
    labels = merged(stored(last, "near-links"))
    final = labels.withColumnRenamed("id", "rep")
    named = classes.join(final, "rep", "left").select("set_hash", "n", F.coalesce("label", "rep").alias("component"))
    named = stored(named, "near-named")
    # Large groups of copies take their component where they are.
    large = named.where(F.col("n") > MANY_COPIES)
    few = broadcast_if_small(large.select("set_hash", "component"), rows=large.count(), row_bytes=100)
    plain = full.select("id", "n_shingles", "set_hash")
    copied = plain.join(few, "set_hash")
    others = plain.join(few, "set_hash", "left_anti").join(named.select("set_hash", "component"), "set_hash", "left")
    alone = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component"))
    found = others.unionByName(copied).select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    return found.unionByName(alone)


def keep_first(docs: DataFrame, size: int) -> DataFrame:
    """One document of each component, the one with the smallest id, columns as they were. Of rows
    with equal id and text one stays."""
    components = stored(find_components(docs, size), "near-components")
    firsts = components.where("id = component").select("id").distinct()
    key = fresh(docs, "near_id")
    keyed = docs.withColumn(key, doc_key(F.col("doc_id")))
    kept = keyed.join(firsts.withColumnRenamed("id", key), key, "left_semi")
    return kept.dropDuplicates([key, "text"]).drop(key)
