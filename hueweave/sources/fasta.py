"""Files of files, FASTA records, and the texts written back."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hueweave.functions.bases import file_stem
from hueweave.sources.store import qualified, store

EXTENSIONS = ("fa", "fna", "fasta", "zst")
FILES = T.StructType([T.StructField("file_id", T.IntegerType(), False), T.StructField("path", T.StringType(), False)])


def files_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, path): the order of the list is the order of the colour bits."""
    return spark.createDataFrame(list(enumerate(paths)), FILES)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a short text file (a list of files) in order, without empty ones; it is read as one row, by Spark."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [line.rstrip("\r") for r in rows for line in r.value.split("\n") if line.strip()]


def read_fof(spark: SparkSession, path: str) -> DataFrame:
    """A file of files: one path a line."""
    return files_table(spark, read_lines(spark, path))


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines `path:index`; paths may hold colons."""
    pairs = [line.rpartition(":") for line in read_lines(spark, path)]
    return spark.createDataFrame([(int(i), p) for p, _, i in pairs], FILES)


def _name_map_lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.concat_ws(":", "path", "file_id").alias("value"))


def write_name_map(files: DataFrame, path: str) -> None:
    """(file_id, path) as lines `path:index`, in the order of the index; one small file, as the driver's lists of files are."""
    _name_map_lines(files).coalesce(1).sortWithinPartitions("file_id").select("value").write.mode("overwrite").text(path)


def _cleaned(uri: str) -> str:
    """One form of the URI of a file: a local one is its path."""
    return re.sub("^file:/+", "/", uri)


def _escaped(path: str) -> str:
    """The path as a pattern that only it matches."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def check_extensions(paths: list[str]) -> None:
    for p in paths:
        ext = p.rsplit("/", 1)[-1].rpartition(".")[2] if "." in p.rsplit("/", 1)[-1] else ""
        if ext not in EXTENSIONS:
            raise ValueError(f"{p}: not a sequence file; known extensions are {', '.join(EXTENSIONS)}")


def read_fasta(files: DataFrame) -> DataFrame:
    """(file_id, record_id, seq) of the FASTA files of (file_id, path), plain or zstd; headers are not kept.

    Records are split by Spark's text reader, so large plain files are read by several tasks; names with a colon, which
    Hadoop's paths don't allow, are read by one task a file. Sequences may stand on
    several lines and end in CR LF. record_id is unique, not consecutive. A path listed twice is read for either id. Paths are
    names, not patterns; one that Spark doesn't list (hidden files, which begin with . or _) raises, so no file is lost in silence.
    """
    spark = files.sparkSession
    listed = [tuple(r) for r in files.select("file_id", "path").collect()]
    check_extensions([p for _, p in listed])
    if not listed:
        return spark.createDataFrame([], "file_id int, record_id long, seq string")
    whole = {p: qualified(spark, p) for p in {p for _, p in listed}}
    named = spark.createDataFrame([(i, _cleaned(whole[p])) for i, p in listed], "file_id int, __uri string")
    colon = sorted(uri for uri in whole.values() if ":" in uri.rpartition("/")[2])
    plain = sorted(set(whole.values()) - set(colon))
    parts = ([_split(spark, plain)] if plain else []) + ([_streamed(spark, colon)] if colon else [])
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    joined = lines.join(F.broadcast(named), F.col("__at") == F.col("__uri"))  # one row a file of the list the driver holds
    body = F.regexp_replace(F.expr("substr(value, greatest(instr(value, '\n'), 1) + if(instr(value, '\n') = 0, length(value), 1))"), "[\r\n]", "")
    return joined.select("file_id", F.monotonically_increasing_id().alias("record_id"), body.alias("seq")).where(F.length("seq") > 0)


def _split(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(value, __at): records of files by Spark's reader."""
    lines = spark.read.option("lineSep", "\n>").text(list(map(_escaped, uris)))
    held = {_cleaned(unquote(f)) for f in lines.inputFiles()}
    if lost := [uri for uri in uris if _cleaned(uri) not in held]:
        raise FileNotFoundError(f"listed but not read: {', '.join(lost)}")
    # the reader tells encoded URIs, in which + stands for itself
    at = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return lines.select("value", at.alias("__at"))


def _streamed(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(value, __at): records of files, each streamed by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            fs, at = store(uri)
            with fs.open_input_stream(at, compression="zstd" if at.endswith(".zst") else None) as f:
                held = b""
                while piece := f.read(1 << 20):
                    *done, held = (held + piece).split(b"\n>")
                    if done:
                        yield rows(done, uri)
                yield rows([held], uri)

    def rows(values: list[bytes], uri: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v.decode() for v in values], pa.string()), pa.array([re.sub("^file:/+", "/", uri)] * len(values), pa.string())], names=["value", "__at"])

    return spark.createDataFrame([(u,) for u in uris], "uri string").repartition(len(uris), "uri").mapInArrow(run, "value string, __at string")


def write_fasta(records: DataFrame, files: DataFrame, width: int = 60, end: str = "\n") -> None:
    """The records (file_id, seq) as the FASTA files of (file_id, path), zstd where the path ends in .zst; one task a file.

    Records stand in the order of their sequences, so a task that runs again writes the same file. Files without records are not written.
    """
    check_extensions([r.path for r in files.collect()])
    spark = files.sparkSession
    named = spark.createDataFrame([(r.file_id, qualified(spark, r.path)) for r in files.collect()], FILES)
    dealt = records.join(F.broadcast(named), "file_id").select("path", "seq").repartition("path").sortWithinPartitions("path", "seq")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sink, n = None, None, 0
        for b in batches:
            for path, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != at:
                    if sink:
                        sink.close()
                    fs, name = store(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    at, sink, n = path, fs.open_output_stream(name, compression="zstd" if path.endswith(".zst") else None), 0
                n += 1
                lines = end.join(seq[i : i + width] for i in range(0, len(seq), width))
                sink.write(f">{n}{end}{lines}{end}".encode())
        if sink:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([0 if at is None else 1], pa.int32())], names=["n"])

    dealt.mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()


def write_dumps(dump: DataFrame, path: str) -> None:
    """(file, seq) as headerless FASTA, one folder Dump_<stem> a file; files of one stem are told apart by their id."""
    stems = dump.select("file_id", "file").distinct().withColumn("stem", file_stem("file"))
    many = stems.groupBy("stem").agg(F.count("*").alias("n"))
    names = stems.join(many, "stem").select("file_id", F.when(F.col("n") > 1, F.concat_ws("_", F.lit("Dump"), "stem", "file_id")).otherwise(F.concat(F.lit("Dump_"), "stem")).alias("dump"))
    dump.join(names, "file_id").select("dump", F.concat(F.lit(">\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("dump").text(path)


def write_stats(per_color: DataFrame, per_length: DataFrame, per_popcount: DataFrame, path: str) -> None:
    """Three tables of statistics as CSV, with their keys."""
    for name, df in (("kmer_per_color", per_color), ("simplitig_per_size", per_length), ("kmer_per_popcount", per_popcount)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
