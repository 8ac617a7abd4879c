"""Statistics over simplitigs and the sizes and offsets of colour buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions.bases import packed_size
from hueweave.operators.running import running_sum


def kmers_per_color(simplitigs: DataFrame, k: int = 31) -> DataFrame:
    return simplitigs.groupBy("color").agg(F.sum(F.col("len") - k + 1).cast("long").alias("n_kmers"))


def simplitigs_per_length(simplitigs: DataFrame) -> DataFrame:
    return simplitigs.groupBy("len").agg(F.count("*").alias("n_simplitigs"))


def kmers_per_popcount(simplitigs: DataFrame, k: int = 31) -> DataFrame:
    """By `popcount`, where there is that column; else color as a mask, as text or as an array of file ids."""
    if "popcount" in simplitigs.columns:
        return simplitigs.groupBy("popcount").agg(F.sum(F.col("len") - k + 1).cast("long").alias("n_kmers"))
    kind = simplitigs.schema["color"].dataType.simpleString()
    n = {"bigint": F.bit_count("color"), "string": F.length(F.regexp_replace("color", "[^1]", ""))}.get(kind, F.size("color") if kind.startswith("array") else None)
    return simplitigs.groupBy(n.cast("int").alias("popcount")).agg(F.sum(F.col("len") - k + 1).cast("long").alias("n_kmers"))


def color_directory(strings: DataFrame, lens: bool = False) -> DataFrame:
    """(color, n_simplitigs, bases, size, start_offset, end_offset) of (color, len, seq): buckets in ascending order of colour.

    Sizes are packed bytes, summed up over ranges of colours. With `lens` a column of that name lists the lengths in the
    order of the strings; a list of its strings' lengths is as long as a colour is large, so archives go without.
    """
    own = strings.groupBy("color").agg(F.count("*").alias("n_simplitigs"), F.sum("len").cast("long").alias("bases"), F.sum(packed_size("len")).cast("long").alias("size"))
    placed = running_sum(own, ["color"], F.col("size"), "end_offset")
    placed = placed.select("color", "n_simplitigs", "bases", "size", (F.col("end_offset") - F.col("size")).alias("start_offset"), "end_offset")
    if not lens:
        return placed
    listed = strings.groupBy("color").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "len"))), lambda x: x["len"]).alias("lens"))
    return placed.join(listed, "color")
