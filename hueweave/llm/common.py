"""What several operators of this subpackage share: the shared folder, hashing of words, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hueweave.operators.running import checkpoint_dir, cut

#: A-Z to a-z and nothing else, for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/hueweave-{uuid.uuid4().hex}"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table. They go in as Arrow: lists of Python rows would start Python workers of their own, which stay."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds))


#: The session's limit on the bytes of an Arrow batch, and what `small_batches` sets it to.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about SMALL_BATCH bytes instead of 64 MB, unless the session has a limit of its own. A longer row is a batch alone."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, SMALL_BATCH)


#: About so many bytes of a batch are worked on at once; a row that is longer goes alone.
SLICE = 8_000_000


def slices(batch: pa.RecordBatch, at: int | None = None, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes, of column `at` or in all, so that what is made of a run stays small."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in [batch.column(at)] if at is not None else batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            sizes += max(1, c.nbytes // max(1, len(c)))
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving unused memory back around it: workers live on, and what they held would count against the tasks after it.

    Functions come pickled by value, so those of earlier tasks, with all tables they refer to, are cycles until collected.
    """

    def give_back() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def arrow_map(df: DataFrame, work: Callable[[dict[str, pa.Array]], dict[str, object]], schema: str) -> DataFrame:
    """work(columns) -> columns, for one slice of an Arrow batch at a time."""
    names = [x.strip().split(" ")[0].split(":")[0] for x in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(released(run), schema)


def sampled_texts(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(h, text) of the n ids of smallest hash, fewer if there are fewer: of an id's texts the first in order, null as the empty text.

    Only hashes are sorted, and of these only about the smallest 4 n; texts of other ids are not moved.
    """
    own = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = own.select("h")
    share = min(1.0, 4 * n / max(1, ids.agg(F.approx_count_distinct("h")).first()[0]))
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    hashes = [r.h for r in ids.where(F.col("h") <= F.lit(bound).cast("long")).distinct().orderBy("h").limit(n).collect()]
    return own.where(F.col("h") <= F.lit(hashes[-1] if hashes else -(1 << 63)).cast("long")).groupBy("h").agg(F.min("text").alias("text"))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


#: A node with over 1 / HUBS of all edges is a hub; so there are under HUBS of them in any list of edges.
HUBS = 1000
#: Nodes whose least neighbours are broadcast (a hash table of about 10 MB, held by the driver too); and edges a partition at least, as small lists
#: in many files cost more than their rows.
NODES, EDGES = 100_000, 10_000
#: Up to so many edges are settled by one task (16 MB of edges), without the jobs, plans and broadcasts of the stars.
SOLO = 1_000_000


def _with_least(rows: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """rows with m, the least `value` of their key; rows has `total` rows at most.

    Least values are combined before the shuffle and, if they are few, broadcast. Else those of hubs are (under HUBS rows), so
    that their rows stay where they are, and the others are joined by key.
    """
    least = cut(rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("d")).coalesce(1 + total // EDGES))
    if least.count() <= NODES:
        return rows.join(F.broadcast(least.select(key, "m")), key)
    hot = F.broadcast(least.where(F.col("d") > total / HUBS).select(key, "m"))
    cold = least.where(F.col("d") <= total / HUBS).select(key, "m")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges: the nodes in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), all in one task, to (node, root)."""
    held = [[b.column(i).to_numpy() for i in range(2)] for b in batches if b.num_rows]
    if held:
        nodes, roots = roots_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", solo: int = SOLO) -> DataFrame:
    """(node, root) of every node of an edge: root is the smallest node reachable. Nodes are longs.

    Up to `solo` edges go to one task. More take alternating large and small stars; after each the edges are written down, so a
    lost executor costs one step. The edges of a hub meet in no task. An edge list without edges gives an empty table.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(e.coalesce(max(1, e.rdd.getNumPartitions() // 16)))
    if seen[0] <= solo:
        return e.coalesce(1).mapInArrow(released(_settled), "node long, root long")
    e = e.coalesce(1 + seen[0] // EDGES)
    while seen[0]:
        near = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select("v", "u"))
        large = _with_least(near, "n", "o", 2 * seen[0]).where("o > n").select(F.col("o").alias("u"), F.least("n", "m").alias("v")).distinct()
        large = cut(large.coalesce(1 + 2 * seen[0] // EDGES))
        # a link to the least neighbour stays, the others become links of both ends' neighbours to it
        small = _with_least(large, "u", "v", 2 * seen[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct().coalesce(1 + 2 * seen[0] // EDGES))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def split_words(texts: pa.Array, sep: str = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place, and where each text's places start (and end); no null texts."""
    lists = pc.split_pattern(texts, sep)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets


def gather(parts: list[bytes], kind: str, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arrays `parts` (bytes of type kind) strung together as the numbers `at` say, and the length of each text."""
    flat, wide = np.frombuffer(b"".join(parts), kind), np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // wide
    starts = np.cumsum(sizes) - sizes
    own = sizes[at]
    before = np.cumsum(own) - own
    total = np.concatenate((before, [own.sum()]))[offsets]
    if not len(flat):
        return flat, np.diff(total)
    small = np.int32 if max(len(flat), own.sum()) < 1 << 31 else np.int64
    return flat[np.repeat((starts[at] - before).astype(small), own) + np.arange(own.sum(), dtype=small)], np.diff(total)
