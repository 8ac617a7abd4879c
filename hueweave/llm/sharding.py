"""Sharding by extendible hashing: a directory indexed by hash-prefix bits; only oversized buckets split on another bit.

DataFrame functions only. Bytes are summed once per directory cell (a prefix `cells` bits long, combined before the
shuffle); a bucket is the shortest prefix whose cells fit the limit, so depths differ from bucket to bucket. Cells that
are themselves too large are counted anew on STEP more bits, and only they, until every bucket fits or the hash is used
up. Rows of one hash (one key) can't be told apart by bits: their bucket gets overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hueweave.llm.common import cut

#: Bits of the hash, bits by which an oversized cell is counted anew, and bits a cell has beyond what even shares would need.
HASH_BITS, STEP, SPARE = 60, 12, 4


def key_hash(key: str) -> Column:
    """The first 60 bits of the MD5 of the key as text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h: str | Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h) if isinstance(h, str) else h, HASH_BITS - bits)


def _leaves(cells: DataFrame, top: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, shard, bytes): of each cell of `bits` bits, its shortest prefix of `top` bits or more that fits the limit; null bytes if none does."""
    at = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"))
    at = at.select("cell", "bytes", "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("shard"))
    sums = at.groupBy("depth", "shard").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    fits = at.join(sums, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "total")).alias("leaf"))
    return cells.join(fits, "cell", "left").select("cell", "leaf.depth", "leaf.shard", F.col("leaf.total").alias("bytes"))


def directory(rows: DataFrame, limit: int, cells: int | None = None) -> DataFrame:
    """(bits, cell, depth, shard, bytes) of all cells, from rows of (h, size); deeper cells only under oversized ones.

    A cell whose hash bits are used up has depth HASH_BITS and its whole bytes, over the limit.
    """
    if cells is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        cells = min(HASH_BITS, max(1, math.ceil(math.log2(max(2, total / limit)))) + SPARE)
    top, bits, found, left = 0, cells, [], rows
    while True:
        sums = left.groupBy(prefix("h", bits).alias("cell")).agg(F.sum("size").alias("bytes"))
        leaves = cut(_leaves(sums, top, bits, limit).withColumn("bits", F.lit(bits)))
        over = leaves.where("depth is null")
        if bits >= HASH_BITS:
            whole = over.drop("bytes").join(sums, "cell").select("cell", F.lit(HASH_BITS).alias("depth"), F.col("cell").alias("shard"), "bytes", "bits")
            return cut(_union([*found, leaves.where("depth is not null"), whole]).select("bits", "cell", "depth", "shard", "bytes"))
        found.append(leaves.where("depth is not null"))
        if over.limit(1).count() == 0:
            return _union(found).select("bits", "cell", "depth", "shard", "bytes")
        left = left.join(over.select(F.col("cell").alias("__o")), prefix("h", bits) == F.col("__o"), "left_semi")
        top, bits = bits + 1, min(HASH_BITS, bits + STEP)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """(key, n_bytes, depth, shard, page, shard_bytes) of each row: the shard is a prefix of `depth` bits of the key's hash.

    Size is the UTF-8 length of the text, null 0. shard_bytes is at most `limit` but where one key alone has more; such a
    bucket is dealt to overflow pages of at most the limit, but for a page of one row that is larger itself. Elsewhere
    page is 0. Null keys share a hash. Repeated rows stay. An empty table gives an empty table. Other columns are not read.
    """
    # texts are read once; the passes over cells read hashes and sizes
    rows = cut(docs.select(F.col(key).alias("key"), key_hash(key).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size")))
    leaves = directory(rows.select("h", "size"), limit, cells)
    levels = sorted(r.bits for r in leaves.select("bits").distinct().collect())
    placed, left = [], rows
    for i, bits in enumerate(levels):
        own = leaves.where(F.col("bits") == bits).select(F.col("cell").alias("__cell"), "depth", "shard", F.col("bytes").alias("shard_bytes"))
        at = left.join(own, prefix("h", bits) == F.col("__cell"), "left" if i + 1 < len(levels) else "inner").drop("__cell")
        placed.append(at.where("depth is not null"))
        left = at.where("depth is null").drop("depth", "shard", "shard_bytes")
    out = ["key", F.col("size").alias("n_bytes"), "depth", "shard", "page", "shard_bytes"]
    if not placed:
        return rows.select(F.col("key").alias(key), F.col("size").alias("n_bytes"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("page"), F.col("size").alias("shard_bytes"))
    whole = _union(placed)
    if not leaves.where(F.col("bytes") > limit).limit(1).count():
        return whole.withColumn("page", F.lit(0).cast("long")).select(*out).withColumnRenamed("key", key)
    # overflow pages: rows of one key are dealt to lots by size and position-free hash, each lot filled in order
    lots = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / F.lit(8 * limit))).cast("int")
    over = whole.where(F.col("shard_bytes") > limit).withColumn("lot", F.pmod(F.monotonically_increasing_id(), lots))
    over = cut(over)  # the numbers of rows stay as they were dealt
    order = Window.partitionBy("shard", "lot").orderBy("size", "key")
    filled = over.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # rows rise in size, so pages that start at most `limit - size` below a multiple of the limit hold at most twice half of it
    half = filled.withColumn("__p", F.floor(F.coalesce("before", F.lit(0)) / F.greatest(F.lit(1), F.lit(limit) - F.max("size").over(Window.partitionBy("shard", "lot")))).cast("long"))
    paged = half.withColumn("page", F.col("lot").cast("long") * F.lit(1 << 32) + F.col("__p"))
    plain = whole.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    return plain.select(*out).unionByName(paged.select(*out)).withColumnRenamed("key", key)


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet, one folder a depth and shard; the rows of a shard meet in one task, which the limit bounds."""
    at = shard(docs, limit, key, text_col).select(F.col(key).alias("__key"), "depth", "shard", "page").distinct()
    named = docs.join(at.withColumn("__name", F.concat_ws("-", "depth", F.hex("shard"), "page")), docs[key].eqNullSafe(F.col("__key"))).drop("__key", "depth", "shard", "page")
    named.repartition("__name").sortWithinPartitions("__name").write.partitionBy("__name").parquet(path)


#: Byte limit of op3's shards.
LIMIT = 250_000


def op3(docs: DataFrame) -> DataFrame:
    return shard(docs, LIMIT)


SQL = f"""
with rows as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h, coalesce(strlen(text), 0)::bigint n_bytes from documents),
depths as (select unnest(range(0, {HASH_BITS} + 1))::int d),
sums as (select d, h >> ({HASH_BITS} - d) p, sum(n_bytes)::bigint b from rows, depths group by all),
leaf as (select h, doc_id, n_bytes, min(d) depth from rows, depths where (d, h >> ({HASH_BITS} - d)) in (select (d, p) from sums where b <= {LIMIT}) group by all)
select doc_id, n_bytes, depth, h >> ({HASH_BITS} - depth) as shard, 0::bigint as page, b as shard_bytes
from leaf join sums on d = depth and p = h >> ({HASH_BITS} - depth)"""
