"""Compress, decompress and statistics as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hueweave.functions.bases import MAX_MASK_FILES
from hueweave.operators import colors, stats
from hueweave.operators.simplitigs import simplitigs
from hueweave.sources.archive import Archive, decompress, write_archive
from hueweave.sources.fasta import read_fasta, read_fof, read_lines, write_dumps, write_stats


def compress(files: DataFrame, path: str, k: int = 31, records: DataFrame | None = None, **how) -> Archive:
    """An archive of the files of (file_id, path); records (file_id, seq) in place of reading them."""
    rows = read_fasta(files) if records is None else records
    n = files.count()
    runs, sets = colors.color_runs(rows, n, k, **how)
    write_archive(path, files, simplitigs(runs, k), k, sets if n > MAX_MASK_FILES else None)
    return Archive(files.sparkSession, path)


def archive_stats(archive: Archive) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K-mers per colour, simplitigs per length, k-mers per popcount; all colours, the one of all files included."""
    rows = archive.colored()
    return stats.kmers_per_color(rows, archive.k), stats.simplitigs_per_length(rows), stats.kmers_per_popcount(rows, archive.k)


def run(spark: SparkSession, mode: str, fof: str | None = None, archive: str | None = None, out: str | None = None, wanted: str | None = None, k: int = 31) -> None:
    """The three modes of the command line."""
    if mode == "compress":
        compress(read_fof(spark, fof), archive, k)
    elif mode == "decompress":
        write_dumps(decompress(Archive(spark, archive), read_lines(spark, wanted) if wanted else None), out)
    elif mode == "stats":
        write_stats(*archive_stats(Archive(spark, archive)), out)
    else:
        raise ValueError(f"unknown mode {mode!r}: compress, decompress or stats")
