"""The archive: Parquet tables `files`, `colors` and `simplitigs`, the last clustered by colour.

colors is the directory: one row a colour with its id (0 is the colour of all files, if there is one), its sorted file
ids, text form, bases, packed size, offsets and bucket. Colours are numbered in ascending order and dealt to buckets of
about `bucket_bytes` packed bytes by their offsets, BUCKETS at most; simplitigs is partitioned by bucket on disk and
sorted by color_id within. A reader that wants some files looks their colours up in the directory, of which the driver
sees a bounded list of buckets and ranges of ids: other buckets' files are not opened, row groups outside the ranges not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.functions.bases import MAX_MASK_FILES, color_files, files_color
from hueweave.operators.running import cut, running_sum
from hueweave.operators.stats import color_directory
from hueweave.sources.store import delete

#: Most buckets of an archive, packed bytes of one, ranges of ids that a scan is given, and rows of the directory that are broadcast.
BUCKETS, BUCKET_BYTES, RANGES, MEMBERS = 4096, 16_000_000, 64, 1_000_000


def write_archive(path: str, files: DataFrame, simplitigs: DataFrame, k: int, sets: DataFrame | None = None, bucket_bytes: int = BUCKET_BYTES) -> None:
    """files (file_id, path), simplitigs (color, len, seq). Overwrites what is there.

    sets: the palette (color, file_ids); without one colours are masks, for 63 files at most.
    """
    spark, n = files.sparkSession, files.count()
    if sets is None and n > MAX_MASK_FILES:
        raise ValueError(f"colours of over {MAX_MASK_FILES} files need their sets")
    files.write.mode("overwrite").parquet(f"{path}/files")
    spark.createDataFrame([(k, n)], "k int, n_files int").write.mode("overwrite").parquet(f"{path}/meta")
    try:
        simplitigs.write.mode("overwrite").parquet(f"{path}/unsorted")
        strings = spark.read.parquet(f"{path}/unsorted")
        listed = color_directory(strings)
        listed = listed.withColumn("file_ids", color_files("color", n)) if sets is None else listed.join(sets, "color")
        listed, size = cut(listed), F.size("file_ids")
        # numbers from 1 in the order of the colours; the colour of all files, a single row, is 0
        some, whole = running_sum(listed.where(size < n), ["color"], F.lit(1), "color_id"), listed.where(size == n).withColumn("color_id", F.lit(0).cast("long"))
        total = listed.agg(F.max("end_offset")).first()[0] or 0
        width = max(bucket_bytes, -(-total // (BUCKETS - 1)))
        named = some.unionByName(whole).withColumn("bucket", F.floor(F.col("start_offset") / width).cast("int"))
        named.select("color_id", "color", "file_ids", files_color("file_ids", n).alias("text"), "n_simplitigs", "bases", "size", "start_offset", "end_offset", "bucket").write.mode("overwrite").parquet(f"{path}/colors")
        colors = spark.read.parquet(f"{path}/colors").select("color_id", "color", "bucket")
        dealt = strings.join(colors, "color").select("bucket", "color_id", "len", "seq").repartitionByRange("bucket", "color_id", "seq").sortWithinPartitions("bucket", "color_id", "seq")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/simplitigs")
    finally:
        delete(spark, f"{path}/unsorted")


class Archive:
    """Tables of an archive; `views` names them for SQL."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.k, self.n_files = spark.read.parquet(f"{path}/meta").first()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    files = property(lambda self: self.table("files"))
    colors = property(lambda self: self.table("colors"))

    @property
    def simplitigs(self) -> DataFrame:
        """(color_id, len, seq, bucket)."""
        return self.spark.read.schema("color_id long, len int, seq string, bucket int").parquet(f"{self.path}/simplitigs")

    def colored(self) -> DataFrame:
        """(color, text, popcount, len, seq)."""
        named = self.colors.select("color_id", "color", "text", F.size("file_ids").alias("popcount"))
        return self.simplitigs.join(named, "color_id").select("color", "text", "popcount", "len", "seq")

    def views(self, prefix: str = "") -> None:
        for name in ("files", "colors", "simplitigs"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def wanted_files(files: DataFrame, wanted: list[str]) -> DataFrame:
    """The files of these exact paths."""
    asked = files.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "path string")
    return files.join(F.broadcast(asked), "path")  # the driver holds the list


def missing_files(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted paths that the archive doesn't know."""
    return files.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "path string").join(files, "path", "left_anti")


def within(ids: DataFrame, most: int = RANGES) -> tuple[list[int], Column]:
    """The buckets of (bucket, color_id, ...), and a predicate on color_id of at most `most` ranges that hold all its ids.

    The driver sees a row a bucket, or if there are few ids, a row an id; ranges between the widest gaps stay apart.
    """
    few = ids.limit(BUCKETS + 1).count() <= BUCKETS
    rows = ids.select("bucket", F.col("color_id").alias("lo"), F.col("color_id").alias("hi")) if few else ids.groupBy("bucket").agg(F.min("color_id").alias("lo"), F.max("color_id").alias("hi"))
    found = sorted((r.lo, r.hi, r.bucket) for r in rows.distinct().collect())
    if not found:
        return [], F.lit(False)
    ends, gaps = sorted((lo, hi) for lo, hi, _ in found), []
    for (_, hi), (lo, _) in zip(ends[:-1], ends[1:], strict=True):
        gaps.append(lo - hi)
    apart = sorted(sorted((i for i, g in enumerate(gaps) if g > 1), key=lambda i: -gaps[i])[: most - 1])
    spans = zip([0, *(i + 1 for i in apart)], [*apart, len(ends) - 1], strict=True)
    tests = [F.col("color_id").between(ends[a][0], max(hi for _, hi in ends[a : b + 1])) for a, b in spans]
    return sorted({b for _, _, b in found}), reduce(lambda x, y: x | y, tests)


def decompress(archive: Archive, wanted: list[str] | None = None, on_missing: str = "error") -> DataFrame:
    """(file_id, file, seq) of all or the wanted files: the strings of every colour that a file takes part in.

    Only buckets and ranges of colours with a wanted file are read, see `within`. Unknown paths raise, or with
    on_missing="skip" are left out.
    """
    files, strings = archive.files, archive.simplitigs
    if wanted is not None:
        if on_missing == "error" and (unknown := [r.path for r in missing_files(files, wanted).collect()]):
            raise ValueError(f"not in the archive: {', '.join(sorted(unknown))}")
        files = wanted_files(files, wanted)
    named = files.select("file_id", F.col("path").alias("file"))
    members = archive.colors.select("color_id", "bucket", F.explode("file_ids").alias("file_id")).join(F.broadcast(named) if archive.n_files <= 100_000 else named, "file_id")
    if wanted is not None:
        members = cut(members)
        buckets, ranges = within(members.select("bucket", "color_id").distinct())
        strings = strings.where(F.col("bucket").isin(buckets) & ranges)
        if members.count() <= MEMBERS:
            members = F.broadcast(members)
    return strings.drop("bucket").join(members.drop("bucket"), "color_id").select("file_id", "file", "seq")
