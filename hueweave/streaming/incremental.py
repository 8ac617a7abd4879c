"""Adding files to coloured k-mers as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from hueweave.functions.bases import MAX_MASK_FILES
from hueweave.operators.colors import color_sets, merge_colors, merge_sets


def stream_colors(records: DataFrame, path: str, checkpoint: str, k: int = 31, n_files: int = MAX_MASK_FILES, **how) -> DataStreamWriter:
    """A writer that merges the k-mers of each batch of (file_id, seq) into a table of (kmer, color, popcount) at `path`.

    Every batch writes path/v=<batch id> from the version before it, so a batch that runs again overwrites its own
    version only. Sets of files join: order, repeats and late files make no difference. Read it with `latest`. Beyond 63
    files (n_files: one more than the largest id that may come) colours are ids of sets, listed at `path`/sets; see `latest_sets`.
    """

    def merge(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        new = color_sets(batch.select("file_id", "seq"), n_files, k, **how)
        held = latest(spark, path, before=i)
        if n_files <= MAX_MASK_FILES:
            kmers = new[0] if held is None else merge_colors(held, new[0])
        else:
            kmers, sets = new if held is None else merge_sets((held, latest(spark, f"{path}/sets", before=i)), new)
            sets.write.mode("overwrite").parquet(f"{path}/sets/v={i}")
        kmers.write.mode("overwrite").parquet(f"{path}/v={i}")

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a batch; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(done)}") if done else None


def latest_sets(spark: SparkSession, path: str) -> DataFrame | None:
    """(color, file_ids) of the newest version beyond 63 files; None if there is none."""
    return latest(spark, f"{path}/sets")
