"""Colours: the set of files of each k-mer, and what follows from it."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions.bases import MAX_MASK_FILES, color_files, popcount, revcomp_code, set_id
from hueweave.operators.kmers import kmer_files, kmer_masks
from hueweave.operators.running import cut, whole_runs
from hueweave.operators.runs import LEAST_K, colored_runs, masks_of, runs_by_bucket, single_runs


def color_sets(records: DataFrame, n_files: int, k: int = 31, **how) -> tuple[DataFrame, DataFrame]:
    """((kmer, color, popcount), palette): one row a distinct canonical k-mer, and what its colour stands for.

    Up to 63 files the colour is a mask. Beyond, it is the id of a set of files, a long as well, and the palette
    (color, file_ids) holds each set once, so that no k-mer carries, shuffles or groups by a list. Equal ids of different sets
    raise. One shuffle, of runs of k-mers by minimizer if k allows, else by k-mer; batches combine their own k-mers before it.
    """
    if n_files <= MAX_MASK_FILES and k >= LEAST_K:
        got = runs_by_bucket(records, k, **how).mapInArrow(masks_of(k, MAX_MASK_FILES), "kmer long, color long").withColumn("popcount", popcount("color"))
        return got, palette(got, n_files)
    if n_files <= MAX_MASK_FILES:
        got = kmer_masks(records, k, **how).groupBy("kmer").agg(F.bit_or("mask").alias("color")).withColumn("popcount", popcount("color"))
        return got, palette(got, n_files)
    rows = kmer_files(records, k, **how).repartition("kmer").sortWithinPartitions("kmer", "file_id")
    rows = cut(rows.mapInArrow(_interned(n_files), "kmer long, color long, popcount int, file_ids array<int>"))
    return rows.select("kmer", "color", "popcount"), _checked(rows.where("file_ids is not null"))


def color_runs(records: DataFrame, n_files: int, k: int = 31, **how) -> tuple[DataFrame, DataFrame]:
    """(runs, palette): the same as (color, salt, n, runs), k-mers of a colour packed in runs, for simplitigs; written down."""
    if k < LEAST_K:
        kmers, sets = color_sets(records, n_files, k, **how)
        return cut(single_runs(kmers, k)), sets
    some = n_files <= MAX_MASK_FILES
    work = colored_runs(k, MAX_MASK_FILES, None if some else Interning(n_files))
    rows = cut(runs_by_bucket(records, k, **how).mapInArrow(work, "color long, salt int, n long, runs binary, file_ids array<int>"))
    runs = rows.where("runs is not null").drop("file_ids")
    return runs, palette(runs, n_files) if some else _checked(rows.where("file_ids is not null").select("color", "file_ids"))


def color_kmers(records: DataFrame, n_files: int, k: int = 31, **how) -> DataFrame:
    """(kmer, color, popcount) alone, see color_sets."""
    return color_sets(records, n_files, k, **how)[0]


def palette(kmers: DataFrame, n_files: int) -> DataFrame:
    """(color, file_ids) of the masks of (color, ...), 63 files at most."""
    return kmers.select("color").distinct().select("color", color_files("color", n_files).alias("file_ids"))


def _checked(listed: DataFrame) -> DataFrame:
    """(color, file_ids), each colour once; two sets of one colour raise."""
    both = listed.groupBy("color").agg(F.min("file_ids").alias("file_ids"), F.max("file_ids").alias("other"))
    return both.select("color", F.expr("if(file_ids = other, file_ids, cast(raise_error('two sets of files have one id') as array<int>))").alias("file_ids"))


#: Colours a task remembers to have listed; beyond, it lists some again.
KNOWN = 500_000


class Interning:
    """Sorted rows (kmer, file), of whole k-mers, to (kmers, colours, sizes, flags, lists of files): flags and lists where a colour is first met."""

    def __init__(self, n_files: int):
        self.tables = [np.array([xxhash.xxh64_intdigest(struct.pack("<i", i), seed) for i in range(n_files)], np.uint64) for seed in (42, 43)]
        self.known: dict[int, int] = {}

    def __call__(self, kmer: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        new = np.concatenate(([True], (kmer[1:] != kmer[:-1]) | (file[1:] != file[:-1])))
        kmer, file = kmer[new], file[new]
        starts = np.flatnonzero(np.concatenate(([True], kmer[1:] != kmer[:-1])))
        size = np.diff(np.concatenate((starts, [len(kmer)])))
        color, check = (np.bitwise_xor.reduceat(t[file], starts).view(np.int64) for t in self.tables)
        ids, at, back = np.unique(color, return_index=True, return_inverse=True)
        known = self.known
        if (check[at][back] != check).any() or any(known.get(c, v) != v for c, v in zip(ids.tolist(), check[at].tolist(), strict=True)):
            raise ValueError("two sets of files have one id")
        first = np.zeros(len(color), bool)
        first[[i for c, i in zip(ids.tolist(), at.tolist(), strict=True) if c not in known]] = True
        known.update(zip(ids.tolist(), check[at].tolist(), strict=True))
        if len(known) > KNOWN:
            self.known = {}
        values, lens = file[np.repeat(first, size)], np.where(first, size, 0)
        offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate((~first, [False]))), pa.array(values))
        return kmer[starts], color, size, first, lists


def _interned(n_files: int):
    """Sorted rows (kmer, file_id) to (kmer, color, popcount, file_ids), file_ids where the task first meets a colour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intern = Interning(n_files)
        for kmer, file in whole_runs([b.column(i).to_numpy() for i in range(2)] for b in batches if b.num_rows):
            x, color, size, _, lists = intern(kmer, file)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(color), pa.array(size.astype(np.int32)), lists], names=["kmer", "color", "popcount", "file_ids"])

    return run


def merge_colors(*parts: DataFrame) -> DataFrame:
    """Coloured k-mers of several sets of files as one, of masks: adding a file is a merge with what is there."""
    out = parts[0].select("kmer", "color")
    for p in parts[1:]:
        out = out.unionByName(p.select("kmer", "color"))
    return out.groupBy("kmer").agg(F.bit_or("color").alias("color")).withColumn("popcount", popcount("color"))


def merge_sets(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two coloured sets of k-mers with their palettes as one, for any number of files; colours become ids of sets.

    K-mers meet by one join; lists of files are joined once for each pair of colours that meet.
    """
    both = cut(a[0].select("kmer", F.col("color").alias("x")).join(b[0].select("kmer", F.col("color").alias("y")), "kmer", "full"))
    of = lambda p, c, name: p.select(F.col("color").alias(c), F.col("file_ids").alias(name))
    met = both.select("x", "y").distinct().join(of(a[1], "x", "p"), "x", "left").join(of(b[1], "y", "q"), "y", "left")
    none = F.array().cast("array<int>")
    named = cut(met.select("x", "y", F.array_sort(F.array_union(F.coalesce("p", none), F.coalesce("q", none))).alias("file_ids")).withColumn("color", set_id("file_ids")))
    to = named.select(F.col("x").alias("__x"), F.col("y").alias("__y"), "color", F.size("file_ids").alias("popcount"))
    kmers = both.join(to, F.col("x").eqNullSafe(F.col("__x")) & F.col("y").eqNullSafe(F.col("__y"))).select("kmer", "color", "popcount")
    return kmers, _checked(named.select("color", "file_ids"))


def omni(kmers: DataFrame, n_files: int) -> DataFrame:
    """K-mers of every file."""
    return kmers.where(F.col("popcount") == n_files)


def multi(kmers: DataFrame, n_files: int) -> DataFrame:
    """K-mers that some file lacks."""
    return kmers.where(F.col("popcount") < n_files)


def per_color(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("color").agg(F.count("*").alias("n_kmers"))


def per_popcount(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("popcount").agg(F.count("*").alias("n_kmers"))


def distinct_totals(kmers: DataFrame, n_files: int) -> DataFrame:
    """(class, n_kmers): distinct k-mers of every file (omni) and of some (multi)."""
    kind = F.when(F.col("popcount") == n_files, "omni").otherwise("multi")
    return kmers.groupBy(kind.alias("class")).agg(F.count("*").alias("n_kmers"))


def churn(kmers: DataFrame, n_files: int, sets: DataFrame | None = None) -> DataFrame:
    """(file_id, n_before, n_removed) for files 1 and up: how many k-mers all files before hold, and how many of these the file lacks.

    A k-mer of file 0 leaves at the first file without it. `sets`: the palette, where colours are no masks.
    """
    counts = kmers.groupBy("color").agg(F.count("*").alias("n"))
    if sets is None:
        first = F.bit_count(F.col("color").bitwiseXOR(F.col("color") + 1)) - 1  # trailing ones: the number of files from 0 on that hold it
    else:
        counts = counts.join(sets, "color")
        gap = F.array_position(F.transform("file_ids", lambda x, i: x != i), True)
        first = F.when(gap > 0, gap - 1).otherwise(F.size("file_ids"))
    left = counts.withColumn("first_missing", F.least(first.cast("int"), F.lit(n_files))).where("first_missing > 0").groupBy("first_missing").agg(F.sum("n").alias("n"))
    files = kmers.sparkSession.range(1, max(n_files, 1)).select(F.col("id").cast("int").alias("file_id"))
    joined = files.join(F.broadcast(left), F.col("first_missing") >= F.col("file_id"), "left")  # at most a row a file on either side
    return joined.groupBy("file_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.coalesce(F.sum(F.when(F.col("first_missing") == F.col("file_id"), F.col("n"))), F.lit(0)).alias("n_removed"))


def neighbours(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, neighbour, side, base): edges of the graph of k-mers, by membership of the four successors and predecessors.

    One join on the k-mer; kmers holds distinct canonical longs.
    """
    mask, top = F.lit((1 << 2 * k) - 1).cast("long"), 2 * (k - 1)
    # the reverse complement of a neighbour follows from that of the k-mer, which is worked out once, before the rows multiply
    own = kmers.select("kmer", revcomp_code("kmer", k).alias("rc"))
    tried = own.select("kmer", "rc", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("kmer", "rc", (F.col("i") < 4).alias("on_right"), F.pmod("i", F.lit(4)).cast("long").alias("base"))
    other = F.lit(3).cast("long") - F.col("base")
    right = F.least(F.shiftleft("kmer", 2).bitwiseAND(mask).bitwiseOR(F.col("base")), F.shiftright("rc", 2).bitwiseOR(F.shiftleft(other, top)))
    left = F.least(F.shiftright("kmer", 2).bitwiseOR(F.shiftleft("base", top)), F.shiftleft("rc", 2).bitwiseAND(mask).bitwiseOR(other))
    tried = tried.select("kmer", F.when(F.col("on_right"), right).otherwise(left).alias("neighbour"), F.when(F.col("on_right"), "right").otherwise("left").alias("side"), F.col("base").cast("int").alias("base"))
    return tried.join(kmers.select(F.col("kmer").alias("neighbour")), "neighbour").select("kmer", "neighbour", "side", "base")
