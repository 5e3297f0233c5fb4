"""The commonest values of a column, without shuffling all distinct ones.

Each task keeps a summary of bounded width. Where it gets too wide, what its first value in
excess counts is taken off all of them; what was taken off in all is the most that any value can
lack, kept or not. Summaries are merged by the same step. The values that are left are counted
exactly, and if the last of the top counts more than any value outside can, none was missed.
Else the summary is made wider; at last all values are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, release

#: Summaries are merged in so many groups before they meet.
SLOTS = 64
#: Summaries are no wider than this; then values are counted as they are.
WIDEST = 1 << 16


class Summary:
    """Counts of at most ``width`` values; no value has more than its count here and ``lack`` together."""

    def __init__(self, width: int):
        self.width, self.lack = width, 0
        self.counts: Counter = Counter()

    def add(self, counts: dict, lack: int = 0) -> Summary:
        self.lack += lack
        self.counts.update(counts)
        if len(self.counts) > 2 * self.width:
            self.narrow()
        return self

    def narrow(self) -> Summary:
        """Take the first count beyond the width off all, and leave what has none left."""
        if len(self.counts) > self.width:
            off = sorted(self.counts.values(), reverse=True)[self.width]
            self.counts = Counter({k: n - off for k, n in self.counts.items() if n > off})
            self.lack += off
        return self


def _summaries(rows: DataFrame, key: str, width: int) -> DataFrame:
    """One summary of a column as rows: value, n and lack, which stands beside a null value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(width)
        for batch in batches:
            values = batch.column(0).value_counts()
            own.add(dict(zip(values.field("values").to_pylist(), values.field("counts").to_pylist())))
        own.narrow()
        kept = list(own.counts.items())
        yield pa.record_batch([pa.array([k for k, _ in kept] + [None], pa.string()), pa.array([n for _, n in kept] + [0], pa.int64()), pa.array([0] * len(kept) + [own.lack], pa.int64())], names=["value", "n", "lack"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        own = Summary(width).add(group.loc[group["value"].notna()].groupby("value")["n"].sum().to_dict(), int(group["lack"].sum())).narrow()
        kept = list(own.counts.items())
        return pd.DataFrame({"slot": 0, "value": [k for k, _ in kept] + [None], "n": [n for _, n in kept] + [0], "lack": [0] * len(kept) + [own.lack]})

    form = "slot int, value string, n bigint, lack bigint"
    parts = rows.select(key).where(F.col(key).isNotNull()).mapInArrow(run, "value string, n bigint, lack bigint")
    slotted = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS))).select("slot", "value", "n", "lack")
    return slotted.groupBy("slot").applyInPandas(merge, form).groupBy(F.lit(0).alias("slot")).applyInPandas(merge, form)


def top_counts(rows: DataFrame, key: str, most: int, order: str = "seq", width: int = 1024) -> DataFrame:
    """The ``most`` commonest values of a column of text, with n; of equal ones that with the least ``order`` first.

    Null values do not count. Summaries begin at ``width`` values, 8 for each that is asked for at least.
    """
    width = max(width, 8 * most)
    while width <= WIDEST:
        found = materialize(_summaries(rows, key, width), "summary")
        lack = found.agg(F.sum("lack")).first()[0] or 0
        listed = F.broadcast(found.where("value is not null").select(F.col("value").alias(key)))  # the width at most
        counts = rows.join(listed, key).groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
        top = materialize(counts.orderBy(F.desc("n"), "_first").limit(most), "top")
        release(found)
        held = top.agg(F.count("*"), F.min("n")).first()
        if not lack or held[0] == most and held[1] > lack:
            return top.orderBy(F.desc("n"), "_first").drop("_first")
        release(top)
        width *= 8
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(most).drop("_first")
