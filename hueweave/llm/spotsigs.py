"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A spot is an anchor and the CHAIN content words (no common words) after it; a document's signature is the set of its spots, as hashes.
The likeness of two documents is the Jaccard of their sets; sets of lengths m <= n have at most m / n, so only sets of
near lengths are compared, through their rarest spots.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm import simhash
from hueweave.llm.common import arrow_map, cut, texts_of
from hueweave.operators.running import following, in_ranges

#: Content words of a chain, and the common words that anchor one (English, German, French, Spanish).
CHAIN = 3
ANCHORS = frozenset(
    "the a an and of to in is was be it that for on with as at by this are from or not "
    "der die das und ist von mit den dem ein eine zu im auf für als auch sich nicht "
    "le la les des et est un une en que qui dans pour par sur pas au aux du de "
    "el los las y del al se con su es lo como más para".split()
)
WORD = re.compile(r"\w+")


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's spots.

    A chain cut short by the end is kept as it is. A text with words but no anchor has one spot, of all its words; one
    without words but not empty, one of the text; the empty text has none. So texts are alike only in what they share.
    """
    words = WORD.findall(text.lower())
    anchors = [i for i, w in enumerate(words) if w in ANCHORS]
    if not anchors:
        return np.array([xxhash.xxh32_intdigest(" ".join(words) if words else text)] if text else [], np.uint32)
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    own = [words[i] for i in content]
    # how many content words stand before each anchor
    before = np.array(anchors) - np.arange(len(anchors))
    digest = xxhash.xxh32_intdigest
    got = {digest(" ".join((words[a], *own[b : b + chain]))) for a, b in zip(anchors, before.tolist(), strict=True)}
    return np.array(sorted(got), np.uint32)


def as_text(sig: np.ndarray) -> str:
    """Eight hexadecimal digits a spot, ascending."""
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; null text counts as empty and has the empty fingerprint."""
    work = lambda c: {"doc_id": c["doc_id"], "fingerprint": [as_text(spots(t)) for t in texts_of(c["text"])]}
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = simhash.LIST) -> DataFrame:
    """(doc_id, component_id) of each row: signatures of Jaccard `threshold` or more link; classes are what links reach.

    Equal signatures are one node, so copies make no pairs. A node is listed under the spots of its prefix, common ones
    last (of two sets that reach the threshold the prefixes meet); a list is parted where lengths rule out a link, one of over
    `most` rows split, and parities of spots prune pairs before the exact Jaccard of the texts' spots. Null text: the empty signature, alike
    only to itself. Rows with a null id have a null component. Repeated rows stay. An empty table gives an empty table.
    """
    of = lambda text: spots(text).astype(np.uint64)
    named = docs.where(F.col(id_col).isNotNull())
    own = cut(simhash.shingle_sets(named, id_col, text_col, of, threshold))
    roots = simhash.near_copies(own, named, id_col, text_col, of, threshold, most)
    nodes = own.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    rest = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("component_id"))
    return own.select("node", F.col("id").alias("doc_id")).join(classes, "node").select("doc_id", "component_id").unionByName(rest)


#: Ids a group of op6; the next document of a group's last comes to it as one more row.
WIDTH = 1024
#: So many heads are broadcast (about 64 MB); more are joined by a shuffle.
HEADS = 1_000_000
#: Rows of a group of ids, beyond which its rows (null or much repeated ids) are dealt in ranges of ids and the first HEAD characters of texts; copies of a row that are given out together.
CROWD, HEAD, LOT = 16 * WIDTH, 64, 1000


def with_next(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """work(id, text, next text) of each row, in descending id order within groups of near ids; the last row's next is the first row.

    Texts are shuffled once, by group; one head row of each group goes to the group above it too. Rows of one id follow
    each other by text. Null ids come last. Rows stream through, so a group may be of any size. Of a group with over
    CROWD rows, equal rows (same id, same text) are one in that order, and the ranges its rows are dealt in are groups; each
    copy of such a row but the last is its own next, and these are dealt in lots.
    """
    lowest = -(1 << 62)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("g", F.coalesce(F.floor(F.col("id") / WIDTH), F.lit(lowest)).cast("long")).withColumn("i", F.coalesce("id", F.lit(lowest)))
    groups = cut(own.groupBy("g").agg(F.max("i").alias("i"), F.count("*").alias("n")))
    small = lambda df: F.broadcast(df) if groups.count() <= HEADS else df
    crowded = groups.where(F.col("n") > CROWD).select("g")
    starts, ranged = groups.where(F.col("n") <= CROWD).select("g", F.lit(0).alias("r"), "i", F.lit(None).cast("string").alias("text")), None
    if crowded.limit(1).count():
        each = own.join(small(crowded), "g", "left_semi").groupBy("g", "i", "id", "text").agg(F.count("*").alias("copies"))
        own = own.join(small(crowded), "g", "left_anti")
        ranged = in_ranges(each, F.desc("g"), F.desc("i"), F.substring("text", 1, HEAD)).withColumnRenamed("__range", "r")
        # i from the largest on, as the complement
        least = ranged.groupBy("g", "r").agg(F.min(F.struct(F.bitwise_not("i").alias("j"), "text")).alias("m"))
        starts = starts.unionByName(least.select("g", "r", F.bitwise_not("m.j").alias("i"), "m.text"))
    own = own.withColumn("r", F.lit(0))
    heads = cut(following(starts.withColumn("at", F.struct("g", (-F.col("r")).alias("s"))), "at", "to"))
    to = [F.col("to.g").alias("to_g"), (-F.col("to.s")).alias("to_r")]
    found = own.join(small(heads.where("text is null").select("g", "i", *to)), ["g", "i"]).groupBy("to_g", "to_r").agg(F.min("text").alias("text"))
    first = found.unionByName(heads.where("text is not null").select(*to, "text"))
    extra = first.select(F.lit(None).cast("long").alias("id"), "text", F.col("to_g").alias("g"), F.col("to_r").alias("r"), F.lit(None).cast("long").alias("i"), F.lit(True).alias("borrowed"))
    columns = ["id", "text", "g", "r", "i"]
    rows = own.select(columns) if ranged is None else own.select(columns).unionByName(ranged.select(columns))
    dealt = rows.withColumn("borrowed", F.lit(False)).unionByName(extra).repartition("g", "r")
    dealt = dealt.sortWithinPartitions("g", "r", "borrowed", F.desc("i"), "text").select("g", "r", "id", "borrowed", "text")

    # a batch may hold null ids only, so types are given
    named = [x.strip().split(" ") for x in schema.split(",")]
    kinds = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for n, k in named])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for g, r, i, borrowed, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    if held[0] != (g, r):
                        raise ValueError("a group without its next head")
                    out.append(work(held[1], held[2], text))
                held = None if borrowed else ((g, r), i, text)
            if out:
                yield pa.RecordBatch.from_pydict({n: [o[n] for o in out] for n in kinds.names}, kinds)

    def repeat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, most = work(i, text, text), max(1, 1_000_000 // (len(text) + 1))
                while left > 0:
                    yield pa.RecordBatch.from_pydict({n: [out[n]] * min(left, most) for n in kinds.names}, kinds)
                    left -= most

    done = dealt.mapInArrow(run, schema)
    if ranged is None:
        return done
    copies = ranged.where("copies > 1").withColumn("lot", F.explode(F.expr(f"sequence(0L, floor((copies - 2) / {LOT}))")))
    lots = copies.select("id", "text", F.expr(f"least({LOT}L, copies - 1 - lot * {LOT})").alias("n"), "lot").repartition("id", F.xxhash64("text"), "lot")
    return done.unionByName(lots.select("id", "text", "n").mapInArrow(repeat, schema))


def edited(text: str, other: str) -> str:
    """text with its last floor(n / 2) code points replaced by as many of the first of other, or all."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def op6(docs: DataFrame) -> DataFrame:
    last: list = [None, None]

    def work(i: int | None, text: str, after: str) -> dict:
        new = edited(text, after)
        a = last[1] if last[0] is text else spots(text)  # the next of the row before
        b, c = spots(new), spots(after)
        last[:] = after, c
        return {
            "doc_id": i, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": as_text(a), "edited_fingerprint": as_text(b),
            "near_edited": likeness(a, b), "near_next": likeness(a, c),
        }

    return with_next(docs, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
