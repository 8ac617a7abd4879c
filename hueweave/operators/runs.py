"""K-mers on the move: windows that follow each other share all bases but one, so runs of them go packed, about ten bits a k-mer.

A run is up to MOST_RUN following windows: how many, and their bases, four a byte. Sequences are cut in runs where the least hashed
canonical m-mer changes; that is the same on either strand, so all places of a k-mer meet in one bucket of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hueweave.functions.bases import revcomp_codes
from hueweave.operators.kmers import _CODE, _pieces, _prepared, _rolled

#: Least k of this form (k-mers of fewer bases repeat too much to be dealt by minimizer), bases of a minimizer, buckets, windows of a run.
LEAST_K, M, BUCKETS, MOST_RUN = 21, 13, 4096, 32
#: Bases cut into runs at once, and k-mers of several buckets that are written together.
BASES, HELD = 1 << 21, 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _A
    x ^= x >> np.uint64(32)
    return x * _B


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:n], x[w - size : w - size + n])


def _split(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, at, n) of the parts of up to MOST_RUN windows of runs of these sizes."""
    parts = -(-size // MOST_RUN)
    of = np.repeat(np.arange(len(size)), parts)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST_RUN
    return of, at, np.minimum(MOST_RUN, size[of] - at)


def _bytes_of(n: np.ndarray, k: int) -> np.ndarray:
    return (n + k + 2) >> 2


def pack(words: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each run's start and the last one ends) of runs as rows of two big-endian words of 64 bases."""
    rows = words.astype(">u8").view(np.uint8).reshape(-1, 16)
    size = _bytes_of(n, k)
    return rows[np.arange(16) < size[:, None]], np.concatenate(([0], np.cumsum(size)))


def unpack(flat: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    rows = np.zeros((len(n), 16), np.uint8)
    rows[np.arange(16) < _bytes_of(n, k)[:, None]] = flat
    return rows.view(">u8").astype(np.uint64)


def windows(words: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, k-mer as it stands) of all windows of runs."""
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    two = (2 * at).astype(np.uint64)
    x = words[of, 0] << two | (words[of, 1] >> np.uint64(1)) >> (np.uint64(63) - two)
    return of, at, (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def _part(words: np.ndarray, at: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The words of n windows from place `at` of each run, bases after them zero."""
    two, left = (2 * at).astype(np.uint64), (2 * (n + k - 1)).astype(np.uint64)  # bits that stay, 2 to 126
    hi = words[:, 0] << two | (words[:, 1] >> np.uint64(1)) >> (np.uint64(63) - two)
    lo = words[:, 1] << two
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    over = np.maximum(left, 64) - np.uint64(64)
    hi &= np.where(left >= 64, full, ~(full >> np.minimum(left, 63)))
    lo &= np.where(over > 0, ~(full >> np.minimum(over, 63)), none)
    return np.stack((hi, lo), axis=1)


def join_runs(words: np.ndarray, n: np.ndarray, k: int, keep: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, n, group) of the runs of those windows that stay (a flag a window), cut where the window's group changes."""
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    new = keep.copy()
    new[1:] &= (of[1:] != of[:-1]) | ~keep[:-1] | (group[1:] != group[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return words[:0], n[:0], group[:0]
    size = np.add.reduceat(keep.astype(np.int64), start)
    return _part(words[of[start]], at[start], size, k), size, group[start]


def _cut_in_runs(files: np.ndarray, seqs: list[bytes], k: int) -> pa.RecordBatch:
    """(bucket, runs) of sequences: runs of a bucket, each once a file."""
    raw = _CODE[np.frombuffer(b"\n".join(seqs) + b"\n", np.uint8)]
    own = np.repeat(files, np.fromiter(map(len, seqs), np.int64, len(seqs)) + 1)
    c = (raw & 3).astype(np.int64)
    least = _sliding_min(_mixed(np.minimum(_rolled(c, M, False), _rolled(3 - c, M, True))), k - M + 1)
    bad = np.concatenate(([0], np.cumsum(raw == 4)))
    ok = bad[k:] == bad[:-k]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "runs"])
    of, at, n = _split(np.add.reduceat(ok.astype(np.int64), start))
    at = start[of] + at
    bases = np.concatenate((raw & 3, np.zeros(64, np.uint8)))[at[:, None] + np.arange(64)]
    bases[np.arange(64) >= (n + k - 1)[:, None]] = 0
    rows = bases[:, 0::4] << 6 | bases[:, 1::4] << 4 | bases[:, 2::4] << 2 | bases[:, 3::4]
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    bucket, file = (least[at] * _A >> np.uint64(40)).astype(np.int64) % BUCKETS, own[at].astype(np.int64)
    order = np.lexsort((words[:, 1], words[:, 0], n, file, bucket))
    words, n, file, bucket = words[order], n[order], file[order], bucket[order]
    same = (words[1:] == words[:-1]).all(1) & (n[1:] == n[:-1]) & (file[1:] == file[:-1]) & (bucket[1:] == bucket[:-1])
    kept = np.concatenate(([True], ~same))
    words, n, file, bucket = words[kept], n[kept], file[kept], bucket[kept]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs(starts, words, n, k, file), pa.binary())], names=["bucket", "runs"])


def blobs(starts: np.ndarray, words: np.ndarray, n: np.ndarray, k: int, file: np.ndarray | None = None) -> list[bytes]:
    """One blob for the runs from each start to the next: the bytes of a file's number and how many runs there are, files, numbers of windows, bases."""
    flat, ends = pack(words, n, k)
    wide = 0 if file is None else 1 if file.max() < 1 << 8 else 2 if file.max() < 1 << 16 else 4
    files, sizes, flat = b"" if file is None else file.astype(f"<u{wide}").tobytes(), n.astype(np.uint8).tobytes(), flat.tobytes()
    spans = zip(starts.tolist(), [*starts[1:].tolist(), len(n)], strict=True)
    return [wide.to_bytes(4, "little") + (e - s).to_bytes(4, "little") + files[wide * s : wide * e] + sizes[s:e] + flat[ends[s] : ends[e]] for s, e in spans]


def read_blobs(held: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, n, file, blob) of the runs of blobs; file is empty without files."""
    files, sizes, flat, own = [], [], [], []
    for b in held:
        wide, count = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little")
        if wide:
            files.append(np.frombuffer(b, f"<u{wide}", count, 8).astype(np.int64))
        sizes.append(np.frombuffer(b, np.uint8, count, 8 + wide * count))
        flat.append(np.frombuffer(b, np.uint8, offset=8 + (wide + 1) * count))
        own.append(count)
    n = np.concatenate(sizes).astype(np.int64)
    return unpack(np.concatenate(flat), n, k), n, np.concatenate(files) if files else np.empty(0, np.int64), np.repeat(np.arange(len(held)), own)


def runs_by_bucket(records: DataFrame, k: int, invalid: str = "compat", on_short: str = "drop") -> DataFrame:
    """(bucket, runs) of records (file_id, seq), dealt and sorted by bucket."""
    rows = _prepared(records, k, invalid, on_short).select("file_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, seqs, size = [], [], 0
            for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f is None or not 0 <= f < 1 << 31:
                    raise ValueError(f"file id {f} is no number from 0 on")
                for piece in _pieces(s, k):
                    files.append(f)
                    seqs.append(piece.encode("ascii", "replace"))
                    size += len(piece)
                    if size >= BASES:
                        yield _cut_in_runs(np.array(files), seqs, k)
                        files, seqs, size = [], [], 0
            if seqs:
                yield _cut_in_runs(np.array(files), seqs, k)

    return rows.mapInArrow(run, "bucket int, runs binary").repartition("bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket."""
    now, held = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(blob)
    if held:
        yield held


def _canonical(held: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """(words, n, file and canonical k-mer of each window)."""
    words, n, file, _ = read_blobs(held, k)
    of, _, x = windows(words, n, k)
    return words, n, file[of], np.minimum(x, revcomp_codes(x, k))


def _masks(file: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, k-mer, mask) of the distinct k-mers, in order. Of places that follow each other, the first ones mostly do too."""
    if file.max() >= most:
        raise ValueError(f"file id {file.max()} has no bit")
    order = np.argsort(x)
    x = x[order]
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return np.minimum.reduceat(order, starts), x[starts], np.bitwise_or.reduceat(np.left_shift(1, file[order]), starts)


def masks_of(k: int, most: int):
    """Sorted rows (bucket, runs) to (kmer, color), each k-mer once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buckets(batches):
            _, _, file, x = _canonical(held, k)
            _, x, mask = _masks(file, x, most)
            for at in range(0, len(x), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]), pa.array(mask[at : at + (1 << 18)])], names=["kmer", "color"])

    return run


def _out(color: np.ndarray, words: np.ndarray, n: np.ndarray, k: int, salt: np.ndarray | None = None) -> pa.RecordBatch:
    """(color, salt, n, runs), a row for each colour and salt."""
    salt = np.zeros(len(color), np.int32) if salt is None else salt.astype(np.int32)
    order = np.lexsort((salt, color))
    color, salt, words, n = color[order], salt[order], words[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], (color[1:] != color[:-1]) | (salt[1:] != salt[:-1]))))
    return pa.RecordBatch.from_arrays(
        [pa.array(color[starts]), pa.array(salt[starts]), pa.array(np.add.reduceat(n, starts)), pa.array(blobs(starts, words, n, k), pa.binary())], names=["color", "salt", "n", "runs"]
    )


def colored_runs(k: int, most: int, interned: Callable | None = None):
    """Sorted rows (bucket, runs) to (color, salt, n, runs, file_ids): each k-mer once, in runs of its colour.

    interned: from sorted pairs of k-mer and file to (k-mers, colours, sizes, flags, lists), where colours are no masks; rows with
    file_ids and no runs list what a colour stands for.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = _out(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.list_(pa.int32()))], names=[*out.schema.names, "file_ids"])

        for blob in _buckets(batches):
            words, n, file, x = _canonical(blob, k)
            if interned is None:
                at, _, color = _masks(file, x, most)
            else:
                order = np.lexsort((file, x))
                _, color, sizes, first, lists = interned(x[order], file[order].astype(np.int32))
                x = x[order]
                at = order[np.concatenate(([True], x[1:] != x[:-1]))]
                if first.any():
                    m = int(first.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(color[first]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), lists.filter(pa.array(first))], names=["color", "salt", "n", "runs", "file_ids"])
            keep, group = np.zeros(len(file), bool), np.zeros(len(file), np.int64)
            keep[at], group[at] = True, color
            words, n, color = join_runs(words, n, k, keep, group)
            held.append((color, words, n))
            size += int(n.sum())
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def single_runs(kmers: DataFrame, k: int) -> DataFrame:
    """(color, salt, n, runs) of (kmer, color): runs of one k-mer each, as nothing is known of its neighbours."""
    kind = kmers.schema["color"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).to_numpy().astype(np.uint64) << np.uint64(64 - 2 * k)
                yield _out(b.column(1).to_numpy(), np.stack((x, np.zeros_like(x)), axis=1), np.ones(len(x), np.int64), k)

    return kmers.select("kmer", "color").mapInArrow(run, f"color {kind}, salt int, n long, runs binary")


def salted(parts: np.ndarray, salt_of: Callable[[np.ndarray], np.ndarray], color: np.ndarray, held: list[bytes], k: int) -> pa.RecordBatch:
    """(color, salt, n, runs) of blobs, whose runs are cut where the salt (of so many parts) changes."""
    words, n, _, blob = read_blobs(held, k)
    of, _, x = windows(words, n, k)
    salt = salt_of(np.minimum(x, revcomp_codes(x, k))) % np.maximum(1, parts[blob][of])
    # the salt and the blob, as the colour goes by the blob
    words, n, both = join_runs(words, n, k, np.ones(len(of), bool), salt * len(held) + blob[of])
    return _out(color[both % len(held)], words, n, k, both // len(held))
