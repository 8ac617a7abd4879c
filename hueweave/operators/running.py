"""Order over whole tables without one task that sees all rows: ranges of the key, and one row a range on the driver."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, one of our own, on a local master only."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        root = tempfile.mkdtemp(prefix="hueweave-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def whole_runs(columns: Iterable[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The same rows, regrouped so that no run of equal first columns is parted."""
    held: list[list[np.ndarray]] = []
    for c in columns:
        if held and held[-1][0][-1] != c[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        last = np.flatnonzero(c[0][1:] != c[0][:-1])
        if len(last):
            held.append([x[: last[-1] + 1] for x in c])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, c = [], [x[last[-1] + 1 :] for x in c]
        held.append(c)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def in_ranges(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df cut in ranges of the keys, numbered in order by the column __range; written down, so that the numbers stay."""
    return cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))


def _by_range(ranged: DataFrame, value: Column, kind: str, fold: Callable[[list], list]) -> DataFrame:
    """(__range, __given): what fold makes of the values of all ranges in order; there are as many rows as shuffle partitions."""
    rows = sorted((r[0], r[1]) for r in ranged.groupBy("__range").agg(value).collect())
    given = zip([r[0] for r in rows], fold([r[1] for r in rows]), strict=True)
    return F.broadcast(ranged.sparkSession.createDataFrame(list(given), f"__range int, __given {kind}"))


def running_sum(df: DataFrame, keys: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of the long `value`, never null, over all rows up to and with this one in the order of the keys, which are unique."""
    ranged = in_ranges(df, *keys)

    def before(sums: list[int]) -> list[int]:
        out, at = [], 0
        for s in sums:
            out.append(at)
            at += s
        return out

    own = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ranged.withColumn("__own", F.sum(value).over(own)).join(_by_range(ranged, F.sum(value).cast("long"), "long", before), "__range")
    return at.withColumn(name, (F.col("__own") + F.col("__given")).cast("long")).drop("__range", "__own", "__given")


def following(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name`: the next larger value of `key`, which is unique and not null; after the largest, the smallest."""
    ranged = in_ranges(df, key)
    after = _by_range(ranged, F.min(key), df.schema[key].dataType.simpleString(), lambda firsts: firsts[1:] + firsts[:1])
    lead = F.lead(key).over(Window.partitionBy("__range").orderBy(key))
    return ranged.withColumn("__lead", lead).join(after, "__range").withColumn(name, F.coalesce("__lead", "__given")).drop("__range", "__lead", "__given")
