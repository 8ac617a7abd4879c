"""Simplitigs: strings whose k-windows are the k-mers of one colour, each once.

Colours are independent, so k-mers are shuffled by colour and each task glues the colours it holds from sorted rows. A
colour of more than `most` k-mers is split by minimizer: neighbours mostly stay together, and a task holds a share of it
only; its strings break where the minimizer changes.

Gluing works on arrays. Each k-mer has two ends, each with the (k-1)-mer by which a walk leaves it; two ends can be joined
if these are reverse complements. Ends sorted by their canonical (k-1)-mer stand in groups of at most eight, whose two
orientations are paired off in order. What is left unpaired in a group is of one orientation, so no string can be
extended by another; only rings of k-mers have to be opened, which is done one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions.bases import ALPHABET, revcomp_codes
from hueweave.operators.running import cut
from hueweave.operators.runs import HELD, read_blobs, salted, single_runs, windows

#: K-mers of a colour up to which it is glued as a whole, and k-mers glued at once (about 300 MB of arrays and lists).
MOST = 1_000_000
#: So many large colours are broadcast; more are joined by a shuffle.
LARGE = 100_000
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def _pairs(x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(partner, junction, orientation) of the ends 2 i (right) and 2 i + 1 (left) of each k-mer; partner -1 if it has none.

    The orientation of ends at a palindrome, where any two can be joined, is 2.
    """
    right, left = x & ((1 << 2 * (k - 1)) - 1), x >> 2
    other, back = revcomp_codes(right, k - 1), revcomp_codes(left, k - 1)
    key = np.stack((np.minimum(right, other), np.minimum(left, back)), axis=1).reshape(-1)
    kind = np.stack((np.where(right == other, 2, right < other), np.where(left == back, 2, back < left)), axis=1).reshape(-1).astype(np.int8)
    word, groups = key << 1 | (kind & 1), np.repeat(group, 2)
    order = np.argsort(word, kind="stable") if not len(group) or group[0] == group[-1] else np.lexsort((word, groups))
    key, kind_at, groups = key[order], kind[order], groups[order]
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (groups[1:] != groups[:-1])))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((starts, [len(key)])))
    junction = np.empty(len(key), np.int64)
    junction[order] = np.repeat(np.arange(len(starts)), size)
    zeros = np.add.reduceat((kind_at == 0).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    any_two = kind_at[starts] == 2
    n = np.where(any_two, size // 2, np.minimum(zeros, size - zeros))
    at = np.repeat(np.arange(len(starts)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = order[starts[at] + np.where(any_two[at], 2 * i, i)]
    b = order[starts[at] + np.where(any_two[at], 2 * i + 1, zeros[at] + i)]
    partner = np.full(len(key), -1, np.int64)
    partner[a], partner[b] = b, a
    # only a run of one base can follow itself; its ends are joined to others if there are any
    for e in np.flatnonzero(partner == np.arange(len(partner)) ^ 1)[::2].tolist():
        mine = np.flatnonzero(junction == junction[e])
        partner[[e, e ^ 1]] = -1
        for end in (e, e ^ 1):
            near = mine[(kind[mine] != kind[end]) & (mine >> 1 != e >> 1)]
            free = near[partner[near] < 0]
            if len(free):
                partner[end], partner[free[0]] = free[0], end
                break
            if len(near):  # between the two ends of another pair
                y = int(near[0])
                z = int(partner[y])
                partner[end], partner[y], partner[e ^ 1 if end == e else e], partner[z] = y, end, z, e ^ 1 if end == e else e
                break
    return partner, junction, kind


def _open_rings(unseen: np.ndarray, partner: np.ndarray, junction: np.ndarray, kind: np.ndarray) -> None:
    """Opens each ring of paired k-mers, where it can be joined to an unpaired end, else anywhere."""
    free: dict[int, list[int]] = {}
    for e in np.flatnonzero(partner < 0).tolist():
        free.setdefault(int(junction[e]), []).append(e)
    done = set()
    for first in unseen.tolist():
        if first in done:
            continue
        ring, e = [], 2 * first + 1
        while e >> 1 not in done:
            done.add(e >> 1)
            ring.append(e ^ 1)
            e = int(partner[e ^ 1])
        for u in ring:
            v, ends = int(partner[u]), free.get(int(junction[u]), [])
            for gone, stays in ((u, v), (v, u)):
                w = next((w for w in ends if kind[w] == kind[gone]), None)
                if w is not None:
                    partner[stays], partner[w], partner[gone] = w, stays, -1
                    ends[ends.index(w)] = gone
                    break
            else:
                continue
            break
        else:
            u = ring[0]
            v = int(partner[u])
            partner[u] = partner[v] = -1
            free.setdefault(int(junction[u]), []).extend((u, v))


def _walk(partner: np.ndarray, n: int) -> tuple[list[int], list[int], bytearray]:
    """The ends by which the k-mers of each string are entered, string after string, where strings start, and the k-mers seen."""
    after = partner.reshape(-1, 2)[:, ::-1].reshape(-1).tolist()  # entered by an end, a k-mer is left by the other
    seen, path, starts = bytearray(n), [], []
    add = path.append
    for e in (np.flatnonzero(partner.reshape(-1, 2)[:, ::-1].reshape(-1) < 0) ^ 1).tolist():  # of a k-mer's two ends the left one first
        if not seen[e >> 1]:
            starts.append(len(path))
            while e >= 0:
                seen[e >> 1] = 1
                add(e)
                e = after[e]
    return path, starts, seen


def glue_groups(x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array]:
    """(group, string) of the strings of distinct canonical k-mers; rows of a group stand together. Deterministic for sorted rows."""
    if not len(x):
        return group[:0], pa.array([], pa.string())
    if k == 1:
        each = {int(g): "".join(ALPHABET[c] for c in x[group == g].tolist()) for g in np.unique(group)}
        return np.array(list(each)), pa.array(list(each.values()), pa.string())
    partner, junction, kind = _pairs(x, group, k)
    path, starts, seen = _walk(partner, len(x))
    if len(path) < len(x):
        _open_rings(np.flatnonzero(np.frombuffer(bytes(seen), np.uint8) == 0), partner, junction, kind)
        path, starts, seen = _walk(partner, len(x))
    ends, first = np.array(path, np.int64), np.array(starts, np.int64)
    words, forward = x[ends >> 1], (ends & 1) == 1
    # the last base of each k-mer as it is walked, and all of the first one's before it
    last = np.where(forward, words & 3, 3 - (words >> 2 * (k - 1))).astype(np.uint8)
    head = np.where(forward[first], words[first], revcomp_codes(words[first], k))
    heads = (head[:, None] >> 2 * np.arange(k - 1, 0, -1)) & 3
    sizes = np.diff(np.concatenate((first, [len(ends)]))) + k - 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    chars = np.empty(offsets[-1], np.uint8)
    is_head = np.zeros(offsets[-1], bool)
    is_head[(offsets[:-1, None] + np.arange(k - 1)).reshape(-1)] = True
    chars[is_head] = heads.reshape(-1)
    chars[~is_head] = last
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LETTERS[chars].tobytes()))
    return group[ends[first] >> 1], strings.cast(pa.string())


def glue(kmers: Iterable[int], k: int) -> list[str]:
    """The strings of one set of canonical k-mers."""
    x = np.unique(np.fromiter(kmers, np.int64))
    return glue_groups(x, np.zeros(len(x), np.int64), k)[1].to_pylist()


def minimizers(x: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least canonical m-mer of each k-mer, as bases.minimizer_code has it."""
    both, mask = (x, revcomp_codes(x, k)), (1 << 2 * m) - 1
    out = np.full(len(x), mask, np.int64)
    for y in both:
        for i in range(k - m + 1):
            np.minimum(out, y >> 2 * i & mask, out=out)
    return out


def simplitigs(kmers: DataFrame, k: int = 31, most: int = MOST, n_partitions: int | None = None) -> DataFrame:
    """(color, len, seq) of (kmer, color), or of the runs of colors.color_runs: deterministic for given k-mers; each k-mer stands in one string of its colour.

    The k-mers are written down once, packed in runs, as the sizes of colours decide how they are dealt out.
    """
    rows = kmers.select("color", "salt", "n", "runs") if "runs" in kmers.columns else cut(single_runs(kmers, k))
    large = cut(rows.groupBy("color").agg(F.sum("n").alias("whole")).where(F.col("whole") > most))
    n_large = large.count()  # at most (all k-mers / most)
    kind = kmers.schema["color"].dataType.simpleString()
    if n_large:
        listed = F.broadcast(large) if n_large <= LARGE else large

        def salt_of(x: np.ndarray) -> np.ndarray:
            return (minimizers(x, k, min(7, k)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

        def dealt_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ends = np.cumsum(b.column(1).to_numpy())
                at = 0
                while at < b.num_rows:  # some rows at once
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                    own = b.slice(at, to - at)
                    yield salted(-(-4 * own.column(3).to_numpy() // most), salt_of, own.column(0).to_numpy(), own.column(2).to_pylist(), k)
                    at = to

        some = rows.join(listed, "color").select("color", "n", "runs", "whole").mapInArrow(dealt_out, f"color {kind}, salt int, n long, runs binary")
        rows = rows.join(listed, "color", "left_anti").unionByName(some)
    dealt = rows.repartition(n_partitions, "color", "salt") if n_partitions else rows.repartition("color", "salt")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def emit(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            words, n, _, blob = read_blobs([r for _, _, r in held], k)
            of, _, x = windows(words, n, k)
            colors, salts = (np.array([r[i] for r in held]) for i in range(2))
            new = np.concatenate(([True], (colors[1:] != colors[:-1]) | (salts[1:] != salts[:-1])))
            group = (np.cumsum(new) - 1)[blob[of]]
            x = np.minimum(x, revcomp_codes(x, k))
            order = np.lexsort((x, group))
            at, strings = glue_groups(x[order], group[order], k)
            out = pa.RecordBatch.from_arrays([pa.array(colors[np.flatnonzero(new)][at]), pa.array(_lengths(strings)), strings], names=["color", "len", "seq"])
            for i in range(0, out.num_rows, 10_000):
                yield out.slice(i, 10_000)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), b.column(2).to_pylist(), strict=True):
                # whole groups are glued as soon as GLUED k-mers are held
                if size >= GLUED and held[-1][:2] != row[:2]:
                    yield from emit(held)
                    held, size = [], 0
                held.append(row[:3])
                size += row[3]
        if held:
            yield from emit(held)

    return dealt.sortWithinPartitions("color", "salt").mapInArrow(run, f"color {kind}, len int, seq string")


#: K-mers of small colours that are glued at once.
GLUED = 250_000


def _lengths(strings: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int32)
