"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of (source, language, topic); the probability of each cell is raked in turn to the target
tokens of every source, language and topic, never above 1, until no probability moves. Documents are then sampled by the
probability of their cell and a hash of their id. Topics are a column of one's own or learnt: clusters of hashed words.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hueweave.llm.common import arrow_map, cut, local_table, released, slices, split_words
from hueweave.llm.sharding import HASH_BITS, key_hash

DIMS = ("source", "lang", "topic")
#: Default target of a value: its share of the tokens to this power, anew in proportion.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
RATE, ROUNDS, TOLERANCE = 0.5, 300, 1e-7
#: A marginal that misses its target by a larger share than this is warned of.
UNMET = 0.01
#: Up to so many cells are raked on the driver and broadcast (about 10 MB); more are raked and joined as tables, in the same way.
SMALL = 100_000
#: Learnt topics, buckets of words, and rounds of k-means at most.
TOPICS, WORDS, FITS = 8, 512, 25
#: Texts whose weighted words are held at once (2 MB).
PART = 512
#: Parts of 1 in which weighted words are summed, as whole numbers: sums are the same in any order, for up to 2^33 texts.
UNITS = 1 << 30
#: Texts a task at least, as a step takes some microseconds a text.
STEP = 20_000
#: Logarithms of the counts that fit in a byte.
LOGS = np.log1p(np.arange(256.0))


class Topics:
    """Spherical k-means of texts as hashed, weighted words."""

    def __init__(self, weights: np.ndarray | None = None, centers: np.ndarray | None = None):
        self.weights, self.centers = weights, centers

    @staticmethod
    def counts(texts: pa.Array) -> np.ndarray:
        """Words of each text by bucket; no nulls."""
        words, at, offsets = split_words(texts)
        own = np.fromiter((xxhash.xxh32_intdigest(w.strip().lower()) % WORDS if w.strip() else WORDS for w in words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        return np.bincount(doc * (WORDS + 1) + own[at], minlength=len(texts) * (WORDS + 1)).reshape(len(texts), WORDS + 1)[:, :WORDS].astype(np.float64)

    def _unit(self, counts: np.ndarray) -> np.ndarray:
        x = (LOGS[counts] if counts.dtype == np.uint8 else np.log1p(counts.astype(np.float64))) * self.weights
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def units(self, packed: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their weighted words) of counts as `packed`, a part at a time."""
        width = pc.binary_length(packed).to_numpy(zero_copy_only=False)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), PART):
                at = rows[i : i + PART]
                yield at, self._unit(unpacked(packed.take(pa.array(at)), w))

    def of(self, texts: pa.Array) -> list[str]:
        """The topic of each text; "none" without words. Equal texts have equal topics in any batch."""
        counts = self.counts(texts)
        if self.centers is None:
            return ["none"] * len(texts)
        at: list[int] = []
        for i in range(0, len(counts), PART):
            at += np.argmax(np.round(self._unit(counts[i : i + PART]) @ self.centers.T, 9), axis=1).tolist()
        return [f"topic {i}" if n else "none" for i, n in zip(at, counts.sum(1).tolist(), strict=True)]


def packed(counts: np.ndarray) -> list[bytes]:
    """Each row as the narrowest numbers that hold it."""
    return [r.astype(np.min_scalar_type(int(m))).tobytes() for r, m in zip(counts, counts.max(1, initial=0).tolist(), strict=True)]


def unpacked(rows: pa.Array, width: int) -> np.ndarray:
    """Rows of `packed` of `width` bytes each."""
    return np.frombuffer(b"".join(rows.to_pylist()), f"<u{width // WORDS}").reshape(-1, WORDS)


def _summed(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sums by number of what work gives for all batches, as long integers; the driver gets one row a number."""

    def give(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["i", "x"])

    def add(sums: dict[int, np.ndarray], i: int, x: np.ndarray) -> None:
        sums[i] = sums[i] + x if i in sums else x

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole):
                for i, x in work(b):
                    add(sums, i, x)
        yield give(sums)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                add(sums, i, np.frombuffer(x, "<i8"))
        yield give(sums)

    each = rows.mapInArrow(released(run), "i int, x binary").repartition(1).mapInArrow(total, "i int, x binary")  # some rows of 4 KB a task
    return {r.i: np.frombuffer(r.x, "<i8") for r in each.collect()}


def learn_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = TOPICS, rounds: int = FITS) -> Topics:
    """Topics of all texts with words, each row one; none if there are none. The order of rows and their ids don't matter.

    The counts of a text's words (mostly 512 bytes) are written down once, and every step reads all of them: how many texts have a
    word, the first centres, which lie farthest from each other, and the rounds, which end when no centre moves.
    """

    def count(c: dict) -> dict:
        own = Topics.counts(c["text"])
        x = packed(own[own.sum(1) > 0])
        return {"key": np.array([xxhash.xxh64_intdigest(r) for r in x], np.uint64).view(np.int64), "x": pa.array(x, pa.binary())}

    rows = cut(arrow_map(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), count, "key long, x binary"))

    def held(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = b.column("x")
        for width in pc.unique(pc.binary_length(x)).to_pylist():
            own = unpacked(x.filter(pc.equal(pc.binary_length(x), width)), width)
            yield 0, np.append((own > 0).sum(0, dtype=np.int64), len(own))

    found = _summed(rows, held).get(0)
    if found is None:
        return Topics()
    rows = rows.coalesce(1 + int(found[-1]) // STEP)
    model = Topics(np.log((1 + found[-1]) / (1 + found[:-1])) + 1e-3)

    def farthest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, the row that is least near to any centre, and of these the one of least key."""
        for whole in batches:
            for b in slices(whole):
                near, key = np.zeros(b.num_rows), b.column("key").to_numpy()
                for at, x in model.units(b.column("x")) if model.centers is not None else ():
                    near[at] = np.round((x @ model.centers.T).max(1), 9)
                best = np.lexsort((key, near))[:1]
                yield pa.RecordBatch.from_arrays([pa.array(near[best]), pa.array(key[best]), b.column("x").take(pa.array(best))], names=["near", "key", "x"])

    for _ in range(min(k, int(found[-1]))):
        r = rows.mapInArrow(released(farthest), "near double, key long, x binary").orderBy("near", "key").first()
        _, x = next(model.units(pa.array([r.x], pa.binary())))
        model.centers = x if model.centers is None else np.concatenate((model.centers, x))

    def gathered(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in model.units(b.column("x")):
            at = np.argmax(np.round(x @ model.centers.T, 9), axis=1)
            whole = np.rint(x * UNITS).astype(np.int64)
            for i in np.unique(at).tolist():
                yield i, whole[at == i].sum(0)

    for _ in range(rounds):
        before, sums = model.centers, _summed(rows, gathered)
        own = np.stack([sums[i] / UNITS if i in sums else c for i, c in enumerate(before)])
        model.centers = own / np.maximum(np.sqrt((own * own).sum(1, keepdims=True)), 1e-12)
        if (model.centers == before).all():
            break
    return model


def tokens(text: str = "text") -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \t-\r]+")).cast("long")


def _named(share: dict, dim: str) -> float:
    """The sum of the shares of present values."""
    total = sum(share.values())
    if not total > 0:
        raise ValueError(f"no target of {dim} names a value that is present")
    return total


def rake(cells: list[tuple], rate: float, targets: dict[str, dict] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of cells (source, lang, topic, tokens) whose expected tokens meet the targets; `rate` of all tokens in sum.

    targets: shares by dimension and value (values not named get none); without one, tempered shares. Targets of a dimension that
    name no present value raise. Marginals that can't be met, as probabilities end at 1, and rounds that run out are warned of.
    """
    size = np.array([c[-1] for c in cells], np.float64)
    total, p, sides = size.sum(), np.full(len(cells), min(1.0, rate)), []
    if not total:
        return p
    for i, d in enumerate(DIMS):
        values = sorted({c[i] for c in cells}, key=lambda v: (v is not None, v))
        index = {v: k for k, v in enumerate(values)}
        at = np.array([index[c[i]] for c in cells])
        held = np.bincount(at, size, len(values))
        if (targets or {}).get(d):
            share = np.array([targets[d].get(v, 0.0) for v in values], np.float64)
            share = share / _named(dict(enumerate(share.tolist())), d)
        else:
            share = np.where(held > 0, held, 1) ** temper[d] * (held > 0)
            share = share / share.sum()
        sides.append((d, values, at, share * rate * total))
    moved = 0.0
    for _ in range(rounds):
        before = p
        for _, _, at, want in sides:
            now = np.bincount(at, p * size, len(want))
            p = np.minimum(1.0, p * np.where(now > 0, want / np.where(now > 0, now, 1), 1)[at])
        moved = np.abs(p - before).max()
        if moved < TOLERANCE:
            break
    _warn(moved, [(d, v, w, n) for d, values, at, want in sides for v, w, n in zip(values, want.tolist(), np.bincount(at, p * size, len(want)).tolist(), strict=True)])
    return p


def _warn(moved: float, rows: list[tuple]) -> None:
    """rows: (dimension, value, target, expected)."""
    if moved >= TOLERANCE:
        warnings.warn(f"raking ended after its last round with probabilities that still moved by {moved:.2g}", stacklevel=3)
    unmet = [f"{d} {v!r}: {n:.0f} of {w:.0f} tokens" for d, v, w, n in rows if abs(n - w) > UNMET * max(w, 1.0)]
    if unmet:
        warnings.warn(f"unmet marginals: {'; '.join(unmet[:20])}", stacklevel=3)


def wanted(cells: DataFrame, dim: str, rate: float, targets: dict[str, dict] | None = None, temper: dict[str, float] = TEMPER) -> DataFrame:
    """(v, want): the target tokens of each value of a dimension."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0] or 0
    if (targets or {}).get(dim):
        given = local_table(spark, [(k, float(v)) for k, v in targets[dim].items()], f"w {cells.schema[dim].dataType.simpleString()}, share double")
        want = cells.select(F.col(dim).alias("v")).distinct().join(F.broadcast(given), F.col("v").eqNullSafe(F.col("w")), "left").select("v", F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        want = cells.groupBy(F.col(dim).alias("v")).agg((F.when(F.sum("tokens") > 0, F.pow(F.sum("tokens"), F.lit(temper[dim]))).otherwise(0.0)).alias("share"))
    whole = _named({0: want.agg(F.sum("share")).first()[0] or 0.0}, dim)
    return cut(want.select("v", (F.col("share") / whole * rate * total).alias("want")))


def rake_table(cells: DataFrame, rate: float, targets: dict[str, dict] | None = None, temper: dict[str, float] = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """The same over a table of cells of any size (source, lang, topic, tokens); adds p. Every side is cut, so a lost executor costs one step."""
    if not cells.agg(F.sum("tokens")).first()[0]:
        return cells.withColumn("p", F.lit(min(1.0, rate)))
    sides = [(d, wanted(cells, d, rate, targets, temper)) for d in DIMS]
    p, moved = cells.withColumn("p", F.lit(min(1.0, rate))), 0.0
    for _ in range(rounds):
        before = p
        for d, want in sides:
            now = p.groupBy(F.col(d).alias("v")).agg(F.sum(F.col("p") * F.col("tokens")).alias("now"))
            factor = now.join(want.withColumnRenamed("v", "w"), F.col("v").eqNullSafe(F.col("w"))).select("v", F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("f"))
            p = cut(p.join(factor, F.col(d).eqNullSafe(F.col("v"))).select(*DIMS, "tokens", F.least(F.lit(1.0), F.col("p") * F.col("f")).alias("p")))
        old = before.select(*(F.col(d).alias(f"old_{d}") for d in DIMS), F.col("p").alias("old_p"))
        same = [F.col(d).eqNullSafe(F.col(f"old_{d}")) for d in DIMS]
        moved = p.join(old, same[0] & same[1] & same[2]).agg(F.max(F.abs(F.col("p") - F.col("old_p")))).first()[0] or 0
        if moved < TOLERANCE:
            break
    off = marginals(p, rate, targets, temper).where(F.abs(F.col("residual")) > UNMET * F.greatest(F.col("target"), F.lit(1.0))).limit(20).collect()
    _warn(moved, [(r.dim, r.value, r.target, r.expected) for r in off])
    return p


def marginals(found: DataFrame, rate: float = RATE, targets: dict[str, dict] | None = None, temper: dict[str, float] = TEMPER) -> DataFrame:
    """(dim, value, target, expected, residual) in tokens, from cells (source, lang, topic, tokens, p): what raking has reached."""
    out = None
    for d in DIMS:
        now = found.groupBy(F.col(d).alias("n")).agg(F.sum(F.col("p") * F.col("tokens")).alias("expected"))
        side = now.join(wanted(found, d, rate, targets, temper), F.col("n").eqNullSafe(F.col("v")))
        side = side.select(F.lit(d).alias("dim"), F.col("v").cast("string").alias("value"), F.col("want").alias("target"), "expected", (F.col("expected") - F.col("want")).alias("residual"))
        out = side if out is None else out.unionByName(side)
    return out


def described(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of: Column | Topics | None = None) -> DataFrame:
    """(row, h, source, lang, topic, tokens): the columns to keep as a struct, so that none clashes, the hash of the id, the dimensions and the tokens."""
    if topic_of is None:
        topic_of = learn_topics(docs, id_col, text_col)
    learnt = isinstance(topic_of, Topics)
    own = docs.select(
        F.struct(*(docs[c] for c in keep)).alias("row"), key_hash(id_col).alias("h"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), tokens(text_col).alias("tokens"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text") if learnt else topic_of.alias("topic"),
    )
    if not learnt:
        return own

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 5):
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(topic_of.of(b.column(5)), pa.string())], names=[*b.schema.names[:5], "topic"])

    return own.mapInArrow(released(run), T.StructType([*own.schema.fields[:5], T.StructField("topic", T.StringType())]))


def sampled(named: DataFrame, rate: float = RATE, targets: dict[str, dict] | None = None, small: int = SMALL) -> DataFrame:
    """The rows of `described` with p, weight and kept: the probability of the cell, over `rate`, and whether the row is sampled.

    Null values of a dimension are a value of their own. Null and empty texts have no tokens; their cells, if they hold
    nothing else, keep `rate`. Rows of one id and cell are kept or dropped together; null ids as if the id were the empty text. An
    empty table stays empty.
    """
    cells = cut(named.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    if cells.limit(small + 1).count() <= small:
        rows = sorted((tuple(r) for r in cells.collect()), key=lambda r: tuple((v is not None, v) for v in r))
        p = [(*c[:-1], float(x)) for c, x in zip(rows, rake(rows, rate, targets), strict=True)]
        kinds = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMS)
        found = F.broadcast(local_table(named.sparkSession, p, f"{kinds}, p double"))
    else:
        found = rake_table(cells, rate, targets).select(*DIMS, "p")
    found = found.select(*(F.col(d).alias(f"_{d}") for d in DIMS), "p")
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("topic").eqNullSafe(F.col("_topic"))
    out = named.join(found, on, "left").drop(*(f"_{d}" for d in DIMS))
    return out.withColumn("weight", F.col("p") / rate).withColumn("kept", F.col("h") < F.col("p") * float(1 << HASH_BITS))


def mix(docs: DataFrame, rate: float = RATE, targets: dict[str, dict] | None = None, **names) -> DataFrame:
    """The sampled documents, with the columns of docs and no others; see `sampled` on nulls, empty texts and repeats.

    Texts are described twice, for the cells and for the sample, rather than written in between.
    """
    names["topic_of"] = names.get("topic_of") if names.get("topic_of") is not None else learn_topics(docs, names.get("id_col", "doc_id"), names.get("text_col", "text"))
    return sampled(described(docs, docs.columns, **names), rate, targets).where("kept").select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    """One row a document: its dimensions, tokens, weight, probability and whether it is sampled."""
    named = cut(described(docs, ["doc_id"]))  # texts are read once
    return sampled(named).select("row.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", F.col("p").alias("probability"), F.col("kept").alias("sampled"))
