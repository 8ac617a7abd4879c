"""The binary exchange format: omnicolour file, multicolour file and zstd colour directory.

Omnicolour: a little-endian u32 length and the packed bases, string after string. Multicolour: packed bases only,
clustered by colour. Directory: zstd text, a line `colour,end offset:length,length,...` a colour, the colour filled up to whole bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.functions.bases import color_string, pack_one, unpack_one
from hueweave.sources.fasta import _escaped
from hueweave.sources.store import qualified, store

OMNI, MULTI, DIRECTORY, NAMES = "omnicolor.bin", "multicolor.bin", "multicolor_bucket_size.txt.zst", "filename_to_color.txt"


def write_binary(path: str, files: DataFrame, simplitigs: DataFrame, n_files: int) -> None:
    """simplitigs (color, len, seq) with masks up to 63 files, or (text, len, seq) with colours as text for any number.

    The files are one stream each, so the driver writes them, one colour after the other.
    """
    spark = files.sparkSession
    fs, base = store(qualified(spark, path))
    fs.create_dir(base, recursive=True)
    rows = simplitigs if "text" in simplitigs.columns else simplitigs.withColumn("text", color_string("color", n_files))
    with fs.open_output_stream(f"{base}/{NAMES}") as f:
        f.write("".join(f"{r.path}:{r.file_id}\n" for r in files.orderBy("file_id").collect()).encode())
    full, width, at, held = "1" * n_files, -(-n_files // 8) * 8, 0, None
    with fs.open_output_stream(f"{base}/{OMNI}") as omni, fs.open_output_stream(f"{base}/{MULTI}") as multi, fs.open_output_stream(f"{base}/{DIRECTORY}", compression=None) as raw:
        with zstandard.ZstdCompressor(level=12).stream_writer(raw, closefd=False) as directory:
            for r in rows.select("text", "seq").sort(F.reverse("text"), "seq").toLocalIterator():
                packed = pack_one(r.seq)
                if r.text == full:
                    omni.write(struct.pack("<I", len(r.seq)) + packed)
                    continue
                if held is not None and held[0] != r.text:
                    directory.write(_line(*held, at, width))
                    held = None
                held = held or (r.text, [])
                multi.write(packed)
                at += len(packed)
                held[1].append(len(r.seq))
            if held is not None:
                directory.write(_line(*held, at, width))


def _line(color: str, lens: list[int], end: int, width: int) -> bytes:
    return f"{color.ljust(width, '0')},{end}:{','.join(map(str, lens))}\n".encode()


def parse_directory(text: str) -> list[tuple[str, int, list[int]]]:
    """(colour text, end offset, lengths) of each line."""
    out = []
    for line in text.split("\n"):
        if line:
            head, _, lens = line.partition(":")
            color, _, end = head.partition(",")
            out.append((color, int(end), [int(x) for x in lens.split(",") if x]))
    return out


def read_omni(raw: bytes) -> list[str]:
    at, out = 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        size = -(-n // 4)
        out.append(unpack_one(raw[at + 4 : at + 4 + size], n))
        at += 4 + size
    return out


def read_binary(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """(text, len, seq) of the files of one folder; with `wanted` file ids, only buckets of colours that hold one are read.

    A line of the directory tells where its bucket lies, so buckets are read by as many tasks as there are partitions of
    lines. The omnicolour file is one chain of lengths, which a single task streams.
    """
    n_files = spark.read.text(_escaped(f"{path}/{NAMES}")).where("trim(value) <> ''").count()
    base = qualified(spark, path)
    line = spark.read.text(_escaped(f"{base}/{DIRECTORY}")).where("value <> ''").select(F.substring_index("value", ":", 1).alias("head"), F.substring_index("value", ":", -1).alias("lens"))
    lists = line.select(F.substring_index("head", ",", 1).alias("color"), F.substring_index("head", ",", -1).cast("long").alias("end"), F.filter(F.split("lens", ","), lambda x: x != "").cast("array<int>").alias("lens"))
    if wanted is not None:
        lists = lists.where(reduce(lambda x, y: x | y, [F.substring("color", i + 1, 1) == "1" for i in wanted], F.lit(False)))

    def multi(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(f"{base}/{MULTI}")
        with fs.open_input_file(at) as f:
            for b in batches:
                for color, end, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.seek(end - sum(-(-n // 4) for n in lens))
                    for i in range(0, len(lens), 1000):
                        yield rows([color[:n_files]] * len(lens[i : i + 1000]), [unpack_one(f.read(-(-n // 4)), n) for n in lens[i : i + 1000]])

    def omni(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                fs, at = store(f"{base}/{OMNI}")
                with fs.open_input_stream(at) as f:
                    held: list[str] = []
                    while head := f.read(4):
                        (n,) = struct.unpack("<I", head)
                        held.append(unpack_one(f.read(-(-n // 4)), n))
                        if len(held) == 1000:
                            yield rows(["1" * n_files] * len(held), held)
                            held = []
                    if held:
                        yield rows(["1" * n_files] * len(held), held)

    def rows(texts: list[str], seqs: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([len(s) for s in seqs], pa.int32()), pa.array(seqs, pa.string())], names=["text", "len", "seq"])

    schema = "text string, len int, seq string"
    dealt = lists.repartition(spark.sparkContext.defaultParallelism, "end")
    return dealt.mapInArrow(multi, schema).unionByName(spark.range(1, numPartitions=1).mapInArrow(omni, schema))
