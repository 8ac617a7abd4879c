"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt to SLICES nodes; a vector's score is the sum of its local scores there.
1. Of a share of the rows, each query's k best local scores of every slice are gathered, and the totals of just these. The
   k-th best of them can't be above the k-th best of all: a safe cutoff, whatever the share.
2. Queries go out with their cutoff. A total that reaches it has a local score of at least cutoff / SLICES in one slice at
   least (whatever the signs), so the entries that do are sufficient. Where the norms of a query and of a block of rows rule that
   out in every slice, no product is formed.
3. Only the sufficient entries' missing local scores are added; totals under the cutoff go, the k best of each task and then
   of all stay.

Rows and queries are packed in blocks, and blocks meet in a grid: a table of blocks of queries, broadcast while it is small,
else shuffled, so neither the driver nor the plan sees more with more queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hueweave.llm.common import cut, released

SLICES = 2
#: Queries and rows of a block; at 64 dimensions half a megabyte each, and 8 MB of local scores a slice.
BLOCK, ROWS = 1024, 1024
#: One in SHARE rows is asked for the cutoff, all if that leaves fewer than LEAST.
SHARE, LEAST = 16, 4096
#: Bytes of packed queries that are broadcast.
BROADCAST = 64_000_000
#: Blocks of queries of which a task holds results at once.
HELD = 16
NONE = np.iinfo(np.int64).min
#: No local score may be as large, so that a total fits a long.
BOUND = (1 << 63) // SLICES


def _usable(vec: str) -> Column:
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(rows: list[list[float]], width: int) -> np.ndarray:
    """floor(1024 x) of each component, short vectors filled with 0; Python integers where a double can't hold a product exactly."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    if not x.size or np.abs(x).max() < 2**40:
        return np.floor(1024 * x)
    return np.array([[int(v) * 1024 if abs(v) >= 2**53 else int(np.floor(1024 * v)) for v in r] for r in x.tolist()], object)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact: doubles while every sum stays under 2^53, else Python integers; raises beyond BOUND."""
    if q.dtype != object and c.dtype != object and (not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53):
        return (q @ c.T).astype(np.int64)
    exact = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape)
    out = exact(q) @ exact(c).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= BOUND:
        raise OverflowError("an inner product doesn't fit a long")
    return out.astype(np.int64)


def parts(width: int) -> list[slice]:
    cuts = [round(width * i / SLICES) for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _norms(x: np.ndarray, width: int) -> np.ndarray:
    """Norm of each row in each slice, rounded up."""
    y = x.astype(np.float64)
    return np.stack([np.sqrt((y[:, s] ** 2).sum(1)) * (1 + 1e-9) for s in parts(width)], axis=1) if len(x) else np.zeros((0, SLICES))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.sort(scores, axis=1)[:, ::-1][:, :k]


def gathered(q: np.ndarray, c: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: of each query, the k best totals of the rows on its lists of the k best local scores; `other`: which rows it may meet."""
    width, n, least = q.shape[1], q.shape[0], min(k, c.shape[0])
    lists, local = [], [product(q[:, s], c[:, s]) for s in parts(width)]
    for s in local:
        s = np.where(other, s, NONE)
        lists.append(np.argpartition(s, s.shape[1] - least, axis=1)[:, -least:])
    at = np.sort(np.concatenate(lists, axis=1), axis=1)
    total = sum(np.take_along_axis(s, at, axis=1) for s in local)
    once = np.concatenate((np.ones((n, 1), bool), at[:, 1:] != at[:, :-1]), axis=1)  # a row in several lists counts once
    return _best(np.where(once & np.take_along_axis(other, at, axis=1), total, NONE), k)


def resolved(q: np.ndarray, c: np.ndarray, other: np.ndarray, cutoff: np.ndarray, norms: tuple[np.ndarray, np.ndarray], count: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, total) of the entries that reach the cutoff.

    count, if given, adds up the entries whose local scores are formed ("local", in slices) and whose totals are ("total").
    """
    width = q.shape[1]
    least = np.where(cutoff == NONE, NONE, -((-cutoff) // SLICES))  # rounded up: local scores are integers
    top = norms[1].max(0) if len(norms[1]) else np.zeros(SLICES)
    ask = np.flatnonzero((least == NONE) | (norms[0] * top[None, :] >= least[:, None]).any(1))  # a query that no row can satisfy
    if not len(ask):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    local = [product(q[ask][:, s], c[:, s]) for s in parts(width)]
    enough = np.logical_or.reduce([s >= least[ask][:, None] for s in local]) & other[ask]
    at, to = np.nonzero(enough)
    total = sum(s[at, to] for s in local)
    if count is not None:
        count["local"] = count.get("local", 0) + SLICES * len(ask) * len(c)
        count["total"] = count.get("total", 0) + len(at)
    good = total >= cutoff[ask][at]
    return ask[at[good]], to[good], total[good]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest score for each query, all if there are fewer; ties to smaller ids.

    Rows with a null id, a null vector or one with a null or non-finite component take no part. A query doesn't meet rows
    of its own id; a repeated query id counts once (the vector of the smallest hash), a repeated candidate as often as it
    occurs. Shorter vectors count as filled with 0. A local score of 2^62 or more in size raises, as a score must be a
    long. Other columns are not read. Empty tables give an empty table.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & _usable("v"))
    cands, asked = pick(vectors), pick(queries)
    asked = asked.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    width = max(1, width)
    blocks = -(-n // block)
    packed = cut(asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("b").sortWithinPartitions("b", "vec_id").mapInArrow(released(_pack_queries), "b int, ids binary, vecs array<array<float>>" if _single(vectors, vec_col) else "b int, ids binary, vecs array<array<double>>"))
    small = n * width * 8 <= BROADCAST

    def grid(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """Blocks of rows, each with every block of queries."""
        kind = "array<array<float>>" if _single(vectors, vec_col) else "array<array<double>>"
        chunks = rows.mapInArrow(released(_pack_rows), f"rows binary, row_vecs {kind}")
        dealt = chunks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else chunks.withColumn("b", F.lit(0))
        return dealt.join(F.broadcast(asked) if small else asked, "b")

    some = cands
    many = cands.count()
    if many // share >= least:
        some = cands.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)

    def phase_1(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b, own, _, q, c, other, _ in _met(batches, width):
            now = gathered(q, c, other, k)
            held[b] = _best(np.concatenate((held[b], now), axis=1), k) if b in held else np.pad(now, ((0, 0), (0, k - now.shape[1])), constant_values=NONE)
            if len(held) > HELD:
                yield from _kept(held)
                held = {}
        yield from _kept(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(raw, np.int64).reshape(-1, k)
                if b != at and at is not None:
                    yield from _kept({at: held})
                    held = None
                at, held = b, now if held is None else _best(np.concatenate((held, now), axis=1), k)
        if at is not None:
            yield from _kept({at: held})

    lists = grid(some, packed).mapInArrow(released(phase_1), "b int, held binary")
    lists = lists.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("b", "lot").sortWithinPartitions("b").select("b", "held").mapInArrow(merge, "b int, held binary")
    cutoffs = cut(lists.repartition("b").sortWithinPartitions("b").mapInArrow(merge, "b int, held binary"))

    def phase_3(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        names: dict[int, np.ndarray] = {}
        for b, own, ids, q, c, other, cutoff in _met(batches, width):
            last = np.full(len(ids), NONE) if cutoff is None else np.frombuffer(cutoff, np.int64).reshape(-1, k)[:, -1]
            at, to, total = resolved(q, c, other, last, (_norms(q, width), _norms(c, width)))
            names[b] = ids
            held.setdefault(b, []).append(np.stack((at, total, own[to]), axis=1))
            if sum(map(len, held[b])) > 4 * k * len(ids) + 10_000:
                held[b] = [_first(np.concatenate(held[b]), k)]
            if len(held) > HELD:
                yield from results(held, names)
                held, names = {}, {}
        yield from results(held, names)

    def results(held: dict[int, list[np.ndarray]], names: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, rows in held.items():
            out = _first(np.concatenate(rows), k)
            yield pa.RecordBatch.from_arrays([pa.array(names[b][out[:, 0]]), pa.array(out[:, 2]), pa.array(out[:, 1])], names=["query_id", "vec_id", "score"])

    found = grid(cands, packed.join(cutoffs, "b", "left")).mapInArrow(released(phase_3), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _single(vectors: DataFrame, vec_col: str) -> bool:
    return vectors.schema[vec_col].dataType.elementType.simpleString() == "float"


def _pack_queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v, b) sorted by b to one row a block."""
    at, ids, vecs = None, [], []
    for batch in batches:
        for i, v, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != at and ids:
                yield _packed(["b", "ids", "vecs"], [at], ids, vecs, batch.column(1).type)
                ids, vecs = [], []
            at = b
            ids.append(i)
            vecs.append(v)
            kind = batch.column(1).type
    if ids:
        yield _packed(["b", "ids", "vecs"], [at], ids, vecs, kind)


def _pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) to one row for each ROWS of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= ROWS:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield _chunk(whole.slice(0, ROWS))
            held = [whole.slice(ROWS)] if whole.num_rows > ROWS else []
    held = [b for b in held if b.num_rows]
    if held:
        yield _chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _chunk(b: pa.RecordBatch) -> pa.RecordBatch:
    return _packed(["rows", "row_vecs"], None, b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(1).type)


def _packed(names: list[str], key: list[int] | None, ids: list[int], vecs: list, kind: pa.DataType) -> pa.RecordBatch:
    own = [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([vecs], pa.list_(kind))]
    return pa.RecordBatch.from_arrays(([] if key is None else [pa.array(key, pa.int32())]) + own, names=names)


def _met(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(block, row ids, query ids, queries, rows, which may meet, cutoff) of each pair of blocks."""
    last, rows = None, None
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            get = lambda n: batch.column(at[n])[i].as_py() if n in at else None  # noqa: B023, E731
            raw = get("rows")
            if raw != last:
                last, own = raw, np.frombuffer(raw, np.int64)
                rows = integers([v[:width] if len(v) > width else v for v in get("row_vecs")], width)
            ids = np.frombuffer(get("ids"), np.int64)
            yield get("b"), own, ids, integers(get("vecs"), width), rows, ids[:, None] != own[None, :], get("held")


def _kept(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["b", "held"])


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Of (query, score, id), the k best of each query."""
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
    starts = np.flatnonzero(new)
    return rows[np.arange(len(rows)) - starts[np.cumsum(new) - 1] < k]


def op4(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10"""
