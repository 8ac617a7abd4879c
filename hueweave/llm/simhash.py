"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most `max_bits` bits differ in at most that many bytes, so of B bytes at least
B - max_bits match by position. A posting list for every single (position, byte) holds 1/256 of all rows and the
pairs from it grow with the square of the corpus; the index here is kept for sets of positions ("blocks") chosen so
that every pair above the bound shares one: its posting lists hold 1/2^32 of unrelated rows. Inside a list the shared
positional bytes are tallied, pairs under the guaranteed minimum are dropped, the rest are verified bit by bit, and
only the edges of a spanning forest leave the list, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hueweave.llm.common import LOWER, arrow_map, components, cut, local_table, released, texts_of
from hueweave.operators.running import whole_runs

#: A posting list above this many rows is dealt out as pairs of chunks of at most about this size, all of which are compared.
CHUNK = 20_000


def steiner_quads() -> list[tuple[int, ...]]:
    """The 14 quadruples of 8 positions of which one avoids any 3 given positions: the words of weight 4 of the extended Hamming code."""
    words = [w for w in range(256) if all(bin(w & m).count("1") % 2 == 0 for m in (0b11111111, 0b00001111, 0b00110011, 0b01010101))]
    return [tuple(i for i in range(8) if w >> i & 1) for w in words if bin(w).count("1") == 4]


def words_of(text: str) -> list[bytes]:
    r"""A-Z lower-cased, words [^\x20\x09-\x0D]+ as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of the whole sequence if there are fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """A bit is 1 if set in over half the hashes; 0 for none."""
    if not len(h):
        return np.uint64(0)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, w0): the 64-bit SimHash of each whole text as a signed long; a null or wordless text has 0."""

    def work(c: dict) -> dict:
        return {"id": c["id"], "w0": np.array([majority(shingle_hashes(words_of(t), shingle)) for t in texts_of(c["text"])], np.uint64).view(np.int64)}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, w0 long")


def _key(words: list[str], block: int, quad: tuple[int, ...]) -> Column:
    """The bytes of fingerprint columns `words` at the positions of the block, and the block's number, as one long."""
    parts = [F.shiftleft(F.shiftrightunsigned(F.col(words[p // 8]), 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long")), 8 * i) for i, p in enumerate(quad)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts, F.lit(block << 32).cast("long"))


def _linker(n_index: int, n_verify: int, min_match: int, max_bits: int):
    """The spanning edges of each run of equal (key, ci, cj); rows come sorted by those."""

    def linked(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        diff = rest ^ x
        same = (np.ascontiguousarray(diff[:, :n_index]).view(np.uint8) == 0).sum(1) >= min_match
        return same & (np.bitwise_count(diff[:, -n_verify:]).sum(1, dtype=np.int64) <= max_bits)

    def forest(nodes: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
        out, left = [], np.arange(len(nodes))
        while len(left) > 1:
            seed, left = left[0], left[1:]
            front = [seed]
            while front and len(left):
                hit = linked(w[front.pop()], w[left])
                found, left = left[hit], left[~hit]
                out += [(int(nodes[seed]), int(nodes[f])) for f in found]
                front += found.tolist()
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> list[tuple[int, int]]:
            """rows: whole runs."""
            ids = rows[:, :3]
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
            w = rows[:, 4:].view(np.uint64)
            two = starts[ends - starts == 2]
            diff = w[two] ^ w[two + 1]
            same = (np.ascontiguousarray(diff[:, :n_index]).view(np.uint8).reshape(len(two), 8 * n_index) == 0).sum(1) >= min_match
            ok = two[same & (np.bitwise_count(diff[:, -n_verify:]).sum(1, dtype=np.int64) <= max_bits)]
            out = list(zip(rows[ok, 3].tolist(), rows[ok + 1, 3].tolist(), strict=True))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 2:
                    out += forest(rows[s:e, 3], w[s:e])
            return out

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            got = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)], axis=1)
            if held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield batch_of(settle(np.concatenate(held)))
                held = []
            last = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
            if len(last):
                held.append(rows[: last[-1] + 1])
                yield batch_of(settle(np.concatenate(held)))
                held = [rows[last[-1] + 1 :]]
            else:
                held.append(rows)
        if held:
            yield batch_of(settle(np.concatenate(held)))

    return run


def links(fps: DataFrame, index: list[str], verify: list[str], blocks: list[tuple[int, ...]], min_match: int, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) of a spanning forest of each posting list; fps: (node, and long columns index + verify), node unique.

    A list of more than `chunk` rows is split in chunks and every pair of chunks becomes a group of its own, so that
    no task holds a list of any size and no link is lost.
    """
    posts = fps.select("node", F.explode(F.array(*[_key(index, i, q) for i, q in enumerate(blocks)])).alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    found = posts.join(often, "key").select("node", "key", own.alias("c"), n.alias("parts"))
    # (c, c) only where there is one part: with more, any pair of chunks holds its two chunks whole
    spread = found.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or o <> c").select("node", "key", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    rows = spread.join(fps, "node").select("key", F.col("ci").cast("long"), F.col("cj").cast("long"), "node", *index, *(x for x in verify if x not in index))
    n_verify = len(verify)
    run = _linker(len(index), n_verify, min_match, max_bits)
    return rows.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: texts whose 64-bit fingerprints differ in at most max_bits <= 3 bits link.

    Null text: the empty text, fingerprint zero, linked like any other. Rows without an id keep a fingerprint, link
    nothing and have a null component. Repeated ids and rows stay as they are. An empty table gives an empty table.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index of quadruples guarantees up to 3 bits")
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = own.where("id is not null").groupBy("w0").agg(F.min("id").alias("id"))
    # an id repeated with other texts is one document: its fingerprints share a component
    nodes = cut(groups.withColumnRenamed("id", "least").select("least", "w0", F.xxhash64("w0").alias("node")))
    edges = links(nodes.select("node", "w0"), ["w0"], ["w0"], steiner_quads(), 8 - max_bits, max_bits, chunk)
    roots = components(edges)
    to = nodes.join(roots, "node", "left").select("w0", "least", F.coalesce("root", "node").alias("root"))
    best = to.groupBy("root").agg(F.min("least").alias("component_id"))
    named = to.join(best, "root").select("w0", "component_id")
    return own.join(named, "w0", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


#: Least Jaccard of the sets of shingles of two copies.
ALIKE = 0.8
#: Bits of the parity sketch, and of a second one of sets of over BITS shingles; about so many texts show which shingles are common; so many
#: common ones are told apart; rows of a list or a part of one; so many ids go to all tasks (8 MB), more are joined by a shuffle.
BITS, WIDE, SAMPLE, COMMON, LIST, IDS = 1024, 4096, 5000, 100_000, 2000, 1_000_000
#: Nodes of most copies that every part of a long list holds.
PIVOTS = 16


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; none for a wordless text."""
    return np.unique(shingle_hashes(words_of(text), k))


def words_in(k: int) -> Callable[[str], np.ndarray]:
    """The set of k-word shingles of a text."""
    return lambda text: shingle_set(text, k)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), 7)).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """A bit for each of BITS parts of the hashes, whether the part holds an odd number, and of WIDE parts if there are many. Two sets differ in at least as many hashes as bits."""
    of = lambda bits: np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()
    return of(BITS) + (of(WIDE) if len(s) > BITS else b"")


def block_keys(fps: np.ndarray) -> np.ndarray:
    """The keys of 64-bit fingerprints in the index of quadruples, a row each, as `_key` has them: fingerprints that differ in up to three bits share one."""
    parts = np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    return np.stack([sum((parts[:, p] << 8 * i for i, p in enumerate(q)), np.full(len(parts), block << 32, np.int64)) for block, q in enumerate(steiner_quads())], axis=1)


def _common(docs: DataFrame, id_col: str, text_col: str, of: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are in several of about SAMPLE texts, and in how many; COMMON at most."""
    few = docs.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    work = lambda c: {"h": pa.array([of(t).view(np.int64) for t in texts_of(c["text"])], pa.list_(pa.int64()))}
    each = arrow_map(few.select(F.col(text_col).alias("text")), work, "h array<long>").select(F.explode("h").alias("h"))
    rows = each.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, often = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], often[order]


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: Callable[[str], np.ndarray] = words_in(5), alike: float = ALIKE) -> DataFrame:
    """(id, node, n, bits, keys, blocks): digest, size and parities of each text's set of shingles, its prefix, and the index keys of its SimHash fingerprint.

    The fingerprint is of the set of shingles, so that equal sets have equal ones.

    The prefix are the n - ceil(alike n) + 1 first of the n shingles in one order of all shingles, so two sets that reach
    `alike` share one of it. Common shingles come last; which are, is known from a sample, on which only speed depends.
    `of` makes a text's set of distinct 64-bit hashes, of five-word shingles if not given.
    """
    h, often = _common(docs, id_col, text_col, of)

    def work(c: dict) -> dict:
        out: dict[str, list] = {"node": [], "n": [], "bits": [], "keys": []}
        fps = []
        for t in texts_of(c["text"]):
            s = of(t)
            rank = np.zeros(len(s), np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                rank = np.where(h[at] == s, often[at], 0)
            first = len(s) - math.ceil(len(s) * alike - 1e-9) + 1
            out["node"].append(set_key(s))
            out["n"].append(len(s))
            out["bits"].append(parities(s))
            fps.append(majority(s))
            out["keys"].append(s[np.lexsort((s, rank))[:first]].view(np.int64))
        return {"id": c["id"], "node": pa.array(out["node"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "bits": pa.array(out["bits"], pa.binary()), "keys": pa.array(out["keys"], pa.list_(pa.int64())), "blocks": pa.array(list(block_keys(np.array(fps, np.uint64))), pa.list_(pa.int64()))}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, node long, n int, bits binary, keys array<long>, blocks array<long>")


def _lists(alike: float, most: int):
    """(nodes, run) of each key whose sizes don't rule out a link, from (key, n, node, copies, root) sorted by (key, n, node); root null: the node.

    Lists of one root go. A list of up to `most` rows has no run. A longer one comes in parts of at most that many rows, numbered by a common
    run, each with the PIVOTS nodes of most copies of the whole list.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([*(b.column(i).to_numpy() for i in range(4)), pc.coalesce(b.column(4), b.column(2)).to_numpy()] for b in batches if b.num_rows)
        for key, n, node, copies, root in whole_runs(columns):
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (n[:-1] < alike * n[1:] - 1e-9)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            size = ends - starts
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            small = mixed & (size <= most)
            if small.any():
                values = node[np.repeat(small, size)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[small]))).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([lists, pa.nulls(len(lists), pa.int64())], names=["nodes", "run"])
            for s, e in zip(starts[mixed & (size > most)].tolist(), ends[mixed & (size > most)].tolist(), strict=True):
                first = node[s:e][np.lexsort((node[s:e], -copies[s:e]))[:PIVOTS]]
                name = xxhash.xxh64_intdigest(node[s:e].tobytes()) >> 1
                for at in range(s, e, most):
                    part = node[at : min(e, at + most)]
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((first[~np.isin(first, part)], part))], pa.list_(pa.int64())), pa.array([name], pa.int64())], names=["nodes", "run"])

    return run


def _may_link(alike: float, every: bool):
    """Pairs of ids (a, b) with their nodes (x, y) in lists of (list, node, n, bits, id, root, part), in which nodes come in one order of all nodes.

    A pair is of different roots, and sizes and parities don't rule out `alike`. Of these, each node's with the first such
    node before it, which is mostly the same in all its lists; or (every) all.

    Unless every, there follow the rows (list, x) of the nodes that are in any such pair of their list, first or not: as roots only
    merge, no other node of the list will ever be in one. Lists that are parts of a longer one (part) give no such rows.
    """
    bound = (1 - alike) / (1 + alike)
    own = BITS // 8

    def differ(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bitwise_count(w ^ v).sum(1, dtype=np.int64)

    def near(at, to: np.ndarray, root: np.ndarray, n: np.ndarray, w: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Which of the rows `to` may link to the row or rows `at`."""
        at = np.broadcast_to(at, to.shape)
        most = bound * (n[at] + n[to]) + 1e-9
        ok = (root[at] != root[to]) & (np.minimum(n[at], n[to]) >= alike * np.maximum(n[at], n[to]) - 1e-9)
        few = np.flatnonzero(ok)
        ok[few] = differ(w[at[few]], w[to[few]]) <= most[few]
        big = np.flatnonzero(ok & (n[at] > BITS) & (n[to] > BITS))
        ok[big] = differ(wide[at[big]], wide[to[big]]) <= most[big]
        return ok

    def pairs(left: np.ndarray, paired: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
        """The pairs of a list; sets `paired` for the rows that are in any."""
        out: list[np.ndarray] = []
        rows = left
        for i in range(left[0], left[-1]):
            left = left[left > i]
            hit = near(i, left, *of)
            found = left[hit]
            if len(found):
                out.append(np.stack((np.full(len(found), i), found)))
                paired[i] = paired[found] = True
                if not every:
                    left = left[~hit]
            elif not every and not paired[i]:
                taken = rows[rows > i]  # those after it that an earlier row took
                paired[i] = near(i, taken[paired[taken]], *of).any()
            if not len(left):
                break
        return out

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        c, bits = [b.column(i) for i in range(7)], b.column(3).to_pylist()
        w = np.frombuffer(b"".join(x[:own] for x in bits), np.uint64).reshape(len(bits), BITS // 64)
        wide = np.frombuffer(b"".join(x[own:].ljust(WIDE // 8, b"\0") for x in bits), np.uint64).reshape(len(bits), WIDE // 64)
        return [c[0].to_numpy(), c[1].to_numpy(), c[2].to_numpy().astype(np.int64), w, wide, c[4].to_numpy(), c[5].to_numpy(), c[6].to_numpy(zero_copy_only=False)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "x", "y", "list"]
        for lists, node, n, w, wide, ids, root, part in whole_runs(columns(b) for b in batches if b.num_rows):
            cuts = np.flatnonzero(lists[1:] != lists[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(lists)]))
            two = starts[ends - starts == 2]
            two = two[near(two, two + 1, root, n, w, wide)]
            paired = np.zeros(len(lists), bool)
            paired[two] = paired[two + 1] = True
            got = [np.stack((two, two + 1))]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 2:
                    got += pairs(np.arange(s, e), paired, root, n, w, wide)
            at, to = np.concatenate(got, axis=1)
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (ids[at], ids[to], node[at], node[to])), pa.nulls(len(at), pa.int64())], names=names)
            if not every:
                left = np.flatnonzero(paired & ~part)
                none = pa.nulls(len(left), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(node[left]), none, pa.array(lists[left])], names=names)

    return run


def _with_ids(docs: DataFrame, ids: DataFrame, most: int = IDS) -> DataFrame:
    """The rows of docs (id, ...) with one of the ids (id), which are distinct and written down.

    Up to `most` ids go to the tasks as one array: a broadcast join would take some hundred bytes an id on the driver.
    """
    if ids.count() > most:
        return docs.join(ids, "id", "left_semi")
    kept = np.sort(ids.where("id is not null").toArrow().column("id").to_numpy())

    @F.arrow_udf("boolean")
    def among(x: pa.Array) -> pa.Array:
        own = pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(kept, own), max(0, len(kept) - 1))
        return pc.and_(pa.array(kept[at] == own if len(kept) else np.zeros(len(own), bool)), pc.is_valid(x))

    return docs.where(among("id"))


def _alike(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, of: Callable[[str], np.ndarray], alike: float) -> DataFrame:
    """(x, y, ok) of the pairs: whether the Jaccard is `alike` or more, from the texts of a and b; of an id's several texts, the one of the right digest counts."""

    def work(c: dict) -> dict:
        ok, last, own = [], None, None
        for x, y, s, t in zip(c["x"].to_pylist(), c["y"].to_pylist(), texts_of(c["s"]), texts_of(c["t"]), strict=True):
            if last != s:
                last, own = s, of(s)
            other = of(t)
            both = len(np.intersect1d(own, other, assume_unique=True))
            ok.append(both >= alike * (len(own) + len(other) - both) - 1e-9 and set_key(own) == x and set_key(other) == y)
        return {"x": c["x"], "y": c["y"], "ok": pa.array(ok, pa.bool_())}

    def texts(end: str, name: str) -> DataFrame:
        """Texts of the pairs' ids only, so that no others are shuffled."""
        ids = cut(pairs.select(F.col(end).alias("id")).distinct())
        return _with_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(name)), ids).withColumnRenamed("id", end)

    named = pairs.join(texts("a", "s"), "a").join(texts("b", "t"), "b")
    return cut(arrow_map(named.select("x", "y", "s", "t"), work, "x long, y long, ok boolean"))


def near_copies(own: DataFrame, docs: DataFrame, id_col: str, text_col: str, of: Callable[[str], np.ndarray] = words_in(5), alike: float = ALIKE, most: int = LIST) -> DataFrame:
    """(node, root) of the nodes of `own` (of shingle_sets, ids known) that are linked: every two sets of Jaccard `alike` or more are in one component, by such links only.

    Nodes that share a key are listed together, each list once. In every round a node is verified against the first
    node before it that sizes and parities admit and that is in another component; nodes of most copies come first, so a
    group mostly gathers around one of them. The first round lists nodes in the index of SimHash fingerprints (see steiner_quads), so all
    that differ in up to three bits meet, which gathers most groups; then under their prefixes, which find the links that no
    fingerprint shows, without lists of one component. All rows of these lists are read in one round: of a list, only
    the nodes that sizes and parities admit to a pair in it go on to the next, so common shingles of unlike texts are not
    joined again. When rounds find no more links, all untested pairs that sizes and parities admit between components are
    verified, in long lists too: there, what is outside the largest component meets all parts.
    """
    first = lambda c: F.first(c).alias(c)  # noqa: E731 these are equal for equal nodes
    nodes = cut(own.groupBy("node").agg(first("n"), first("bits"), first("keys"), first("blocks"), F.min("id").alias("id"), F.count("*").cast("int").alias("copies")))
    facts = nodes.select("node", "n", "bits", "id", "copies")
    roots: DataFrame | None = None
    links: DataFrame | None = None
    tested: DataFrame | None = None

    def rooted(rows: DataFrame) -> DataFrame:
        """rows of (node, ...) with their root."""
        return rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def listed(keys: str) -> DataFrame:
        """(nodes, run, list) of the nodes that share one of their `keys`."""
        own = rooted(nodes.select("node", "n", "copies", keys))
        posts = own.select(F.explode(keys).alias("key"), "n", "node", "copies", F.nullif("root", "node").alias("root")).repartition("key").sortWithinPartitions("key", "n", "node")
        return cut(posts.mapInArrow(released(_lists(alike, most)), "nodes array<long>, run long").distinct().withColumn("list", F.xxhash64("nodes", "run")))

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of lists of several roots."""
        if roots is None:
            return rows
        return rows.join(rows.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list"), "list")

    def candidates(rows: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
        """rows: (list, node, root, part); the pairs (a, b, x, y) and the rows (list, node, part) of whole lists that have any."""
        named = rows.select("list", "node", "root", "part").join(facts, "node")
        dealt = named.select("list", "node", "n", "bits", "id", "root", "part", "copies").repartition("list").sortWithinPartitions("list", F.desc("copies"), "node")
        found = cut(dealt.mapInArrow(released(_may_link(alike, every)), "a long, b long, x long, y long, list long").distinct())
        return found.where("list is null").drop("list"), found.where("list is not null").select("list", F.col("x").alias("node"), F.lit(False).alias("part"))

    def test(pairs: DataFrame) -> bool:
        """Verifies those of the pairs that are new; whether there are more links."""
        nonlocal roots, links, tested
        new = pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti")
        got = _alike(new, docs, id_col, text_col, of, alike)
        good = got.where("ok").select("x", "y")
        tested = got.select("x", "y") if tested is None else tested.unionByName(got.select("x", "y"))
        if not good.limit(1).count():
            return False
        links = good if links is None else links.unionByName(good)
        roots = cut(components(links, "x", "y"))
        return True

    def rows_of(lists: DataFrame) -> DataFrame:
        return lists.select("list", "run", F.explode("nodes").alias("node"), F.col("run").isNotNull().alias("part"))

    # lists are made without those of one root, so the first rows of each kind need no look at `mixed`
    test(candidates(rooted(rows_of(listed("blocks"))), False)[0])
    lists = listed("keys")
    long = lists.where("run is not null")
    some, at = candidates(rooted(rows_of(lists)), False)
    while some.limit(1).count() and test(some):
        parts = rows_of(long).select("list", "node", "part")
        some, at = candidates(mixed(cut(rooted(at.unionByName(parts)))), False)
    if long.limit(1).count():
        # a long list's nodes outside its largest component, with all of its parts
        own = cut(rooted(rows_of(long)))
        largest = own.groupBy("run", "root").count().groupBy("run").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
        outside = own.join(largest, "run").where("root <> largest").groupBy("run", "list").agg(F.collect_set("node").alias("others"))  # up to `most` and PIVOTS nodes
        parts = long.select("run", F.col("list").alias("to"), "nodes")
        met = outside.join(parts, "run").select(F.xxhash64("list", "to").alias("list"), F.explode(F.array_union("others", "nodes")).alias("node"), F.lit(True).alias("part"))
        at = at.unionByName(met)
    if at.limit(1).count():
        test(candidates(mixed(cut(rooted(at))), True)[0])
    return roots if roots is not None else local_table(docs.sparkSession, [], "node long, root long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = ALIKE) -> DataFrame:
    """docs with one row of each group of copies: the one of smallest id.

    SimHash fingerprints that share a block of the index give the first candidates, an exact join of shingles those that they miss; see
    near_copies. Either are verified by the sets themselves.
    Copies are texts whose sets of five-word shingles have a Jaccard of `alike` or more, and what such links reach. Null text
    counts as empty; all empty texts are copies of each other. Rows without an id stay. Rows of one id whose texts are no
    copies of each other stay each for itself; of those that are, the one of the smallest digest of its shingles, then of its
    columns. An empty table stays empty; other columns are kept as they are.
    """
    own = cut(shingle_sets(docs, id_col, text_col, words_in(shingle), alike).where("id is not null"))
    roots = near_copies(own, docs, id_col, text_col, words_in(shingle), alike)
    to = own.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    kept = to.groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select("k.id", "k.node")
    counts = own.groupBy("id").count()
    gone = counts.select("id").join(kept.select("id"), "id", "left_anti")
    many = counts.where("count > 1").select("id")
    if not many.limit(1).count():
        return _without(docs, gone, id_col)
    kept, many = cut(kept), cut(many.withColumnRenamed("id", "__many"))
    some = docs.join(many, docs[id_col] == many["__many"], "left_semi")
    again = some.select(F.struct(*some.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(*some.columns).alias("own"))
    again = _keyed(again, shingle).join(kept, ["id", "node"])
    least = again.groupBy("id", "node").agg(F.min("own").alias("own"))
    one = again.join(least, ["id", "node", "own"]).select("row.*").distinct()
    return _without(docs, gone.union(many), id_col).unionByName(one)


def _without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows of these ids; rows without an id stay."""
    gone = ids.select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def _keyed(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, id, own, node) of (row, id, text, own): node is the digest of the text's set of shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([set_key(shingle_set(t, shingle)) for t in texts_of(b.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), keys], names=["row", "id", "own", "node"])

    f = rows.schema
    return rows.mapInArrow(released(run), T.StructType([f["row"], f["id"], f["own"], T.StructField("node", T.LongType())]))
