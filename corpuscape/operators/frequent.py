"""The most frequent values exactly, without moving the vocabulary.

A combined aggregation sends every distinct value of every task through the shuffle. Here each task
writes its counts as one or more lists, and three rounds over the lists decide what has to move
(threshold algorithm in three phases, Cao and Wang 2004):

1. the k first values of each list give a lower bound ``low`` of the k-th largest total;
2. a value with a total of ``low`` or more has ``low / lists`` or more in some list. Only such entries
   move; their sums raise the bound, and what a list may hide rules values out;
3. the totals of the values that are left are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscape.runtime import broadcast_if_small, stored

# Distinct values that a task counts before it closes a list and starts another.
LIST_VALUES = 1_000_000


@dataclass
class CountLists:
    """``rows`` has ``task, list, value, n, leads``: entries of a list in descending order, so that files
    can skip row groups by ``n``; the first ``k`` of a list lead."""

    rows: DataFrame
    n_lists: int
    k: int


def _merged(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by("value").aggregate([("n", "sum")])
    return found.rename_columns({"n_sum": "n"}).select(["value", "n"])


def count_lists(df: DataFrame, values: str, k: int, list_values: int = LIST_VALUES) -> CountLists:
    """Counts of the strings in the array column ``values``, as lists that no shuffle has seen.

    A task holds ``list_values`` distinct values and one batch. Null arrays and null elements count nothing.
    """

    def closed(found: pa.Table, number: int) -> pa.Table:
        order = found.sort_by([("n", "descending"), ("value", "ascending")])
        same = [pa.repeat(pa.scalar(x, pa.int32()), len(order)) for x in (TaskContext.get().partitionId(), number)]
        leads = pa.array(np.arange(len(order)) < k)
        columns = [*same, order["value"], order["n"], leads]
        return pa.table(columns, names=["task", "list", "value", "n", "leads"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, number = [], 0, 0
        for batch in batches:
            seen = pc.value_counts(batch.column(0).flatten().drop_null())
            if len(seen):
                held.append(pa.table([seen.field("values"), seen.field("counts")], names=["value", "n"]))
                waiting += len(seen)
            # Merging only when the parts have doubled keeps the work in proportion to the input.
            if waiting >= 2 * list_values:
                held = [_merged(held)]
                waiting = len(held[0])
                if waiting >= list_values:
                    yield from closed(held[0], number).to_batches()
                    held, waiting, number = [], 0, number + 1
        if held:
            yield from closed(_merged(held), number).to_batches()

    schema = "task int, list int, value string, n bigint, leads boolean"
    rows = stored(df.select(values).mapInArrow(counted, schema), "count-lists")
    # A list that is not empty has a first entry, and leads are a filter that files answer.
    n_lists = rows.where("leads").agg(F.count_distinct("task", "list")).first()[0]
    return CountLists(rows, n_lists, k)


def _bound(totals: DataFrame, k: int) -> int:
    """The k-th largest sum, or 0 where there are fewer sums."""
    last = totals.orderBy(F.desc("n")).limit(k).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    return last["n"] if last["rows"] == k else 0


def candidates(lists: CountLists) -> DataFrame:
    """``value``: a superset of the k most frequent values with all ties of the last one."""
    rows = lists.rows.select("value", "n", "leads")
    low = _bound(rows.where("leads").groupBy("value").agg(F.sum("n").alias("n")), lists.k)
    least = -(-low // max(1, lists.n_lists))
    sums = stored(
        rows.where(F.col("n") >= least).groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("met")),
        "sums",
    )
    # A list in which the value is not met holds at most least - 1 of it.
    hidden = (lists.n_lists - F.col("met")) * max(0, least - 1)
    return sums.where(F.col("n") + hidden >= _bound(sums, lists.k)).select("value")


def most_frequent(df: DataFrame, values: str, k: int, list_values: int = LIST_VALUES) -> DataFrame:
    """``value, n``: the k most frequent strings of an array column, ties in the order of the values.

    Exact for any split of the rows. Per list about k entries move, however many values there are; texts are
    read once. Fewer than k distinct values are all returned; an empty table gives no rows.
    """
    lists = count_lists(df, values, k, list_values)
    wanted = stored(candidates(lists), "candidates")
    met = lists.rows.join(broadcast_if_small(wanted), "value", "left_semi")
    totals = met.groupBy("value").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "value").limit(k)
