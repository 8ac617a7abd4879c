"""From sequences to canonical k-mers and the files that hold them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.functions.bases import MAX_MASK_FILES, canonical, check_k, effective_sequence

#: Windows of a chunk in the SQL form: substr costs by position, so long sequences are cut first.
CHUNK = 200
#: Bases handled at once in the Arrow form; longer sequences go in overlapping pieces.
PIECE = 1 << 20


def _prepared(records: DataFrame, k: int, invalid: str, on_short: str) -> DataFrame:
    """records with seq as it is to be cut in windows; too short ones go or raise."""
    check_k(k)
    if invalid not in ("compat", "break") or on_short not in ("drop", "error"):
        raise ValueError("invalid is 'compat' or 'break', on_short 'drop' or 'error'")
    out = records.withColumn("seq", F.expr(f"case when length(seq) < {k} then raise_error(concat('a sequence is shorter than ', {k})) else seq end")) if on_short == "error" else records
    out = out.where(F.length("seq") >= k)
    return out.withColumn("seq", effective_sequence("seq", k)) if invalid == "compat" else out


def window_strings(records: DataFrame, k: int = 31, invalid: str = "compat", on_short: str = "drop") -> DataFrame:
    """Every k-window of seq as `kmer` (a string as it stands), beside the other columns; expressions only.

    invalid="compat" skips characters other than ACGT as `effective_sequence` tells; "break" leaves out windows that hold one.
    """
    rows = _prepared(records, k, invalid, on_short)
    keep = [c for c in rows.columns if c != "seq"]
    chunk = rows.select(*keep, F.explode(F.expr(f"transform(sequence(0, (length(seq) - {k}) div {CHUNK}), i -> substr(seq, i * {CHUNK} + 1, {CHUNK + k - 1}))")).alias("__chunk"))
    out = chunk.select(*keep, F.explode(F.expr(f"transform(sequence(1, length(__chunk) - {k} + 1), i -> substr(__chunk, i, {k}))")).alias("kmer"))
    return out.where(~F.col("kmer").rlike("[^ACGT]")) if invalid == "break" else out


def canonical_strings(records: DataFrame, k: int = 31, **how) -> DataFrame:
    return window_strings(records, k, **how).withColumn("kmer", canonical("kmer"))


_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def codes_of(seq: str, k: int, invalid: str = "break") -> np.ndarray:
    """Canonical k-mers of a sequence as int64, in order; windows with other characters than ACGT are left out."""
    raw = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(raw) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    c = (raw & 3).astype(np.int64)
    fwd = _rolled(c, k, False)
    rev = _rolled(3 - c, k, True)
    out = np.minimum(fwd, rev)
    bad = np.concatenate(([0], np.cumsum(raw == 4)))
    return out if not bad[-1] else out[bad[k:] == bad[:-k]]


def _rolled(c: np.ndarray, k: int, low_first: bool) -> np.ndarray:
    """Windows of k two-bit codes as numbers, built from windows of 1, 2, 4, ... codes."""
    n, out, done, part, size = len(c) - k + 1, np.zeros(len(c) - k + 1, np.int64), 0, c, 1
    while done < k:
        if k >> (size.bit_length() - 1) & 1:
            own = part[done : done + n]
            out = out | own << 2 * done if low_first else out << 2 * size | own
            done += size
        if done < k:
            a, b = part[:-size] if len(part) > size else part[:0], part[size:]
            part = a | b << 2 * size if low_first else a << 2 * size | b
        size *= 2
    return out


def _pieces(seq: str, k: int) -> Iterator[str]:
    for at in range(0, max(1, len(seq) - k + 1), PIECE):
        yield seq[at : at + PIECE + k - 1]


def kmer_masks(records: DataFrame, k: int = 31, invalid: str = "compat", on_short: str = "drop") -> DataFrame:
    """(kmer long, mask long) of records (file_id, seq): what one batch of records holds of each canonical k-mer, its files
    already combined. Partial rows: sum them up with bit_or (see colors.color_kmers). File ids from 0 to 62."""
    rows = _prepared(records, k, invalid, on_short).select("file_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers, masks = [], []
            for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not 0 <= f < MAX_MASK_FILES:
                    raise ValueError(f"file id {f} has no bit; use kmer_files")
                for piece in _pieces(s, k):
                    got = np.unique(codes_of(piece, k))
                    kmers.append(got)
                    masks.append(np.full(len(got), 1 << f, np.int64))
            if kmers:
                x, m = np.concatenate(kmers), np.concatenate(masks)
                order = np.argsort(x, kind="stable")
                x, m = x[order], m[order]
                starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
                for at in range(0, len(starts), 1 << 18):
                    part = starts[at : at + (1 << 18)]
                    end = starts[at + (1 << 18)] if at + (1 << 18) < len(starts) else len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part]), pa.array(np.bitwise_or.reduceat(m[:end], part))], names=["kmer", "mask"])

    return rows.mapInArrow(run, "kmer long, mask long")


def kmer_files(records: DataFrame, k: int = 31, invalid: str = "compat", on_short: str = "drop") -> DataFrame:
    """(kmer long, file_id int), distinct within a file's records of a batch; for any number of files."""
    rows = _prepared(records, k, invalid, on_short).select("file_id", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, list[np.ndarray]] = {}
            for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(s, k):
                    own.setdefault(f, []).append(np.unique(codes_of(piece, k)))
            for f, parts in own.items():
                got = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), f, np.int32))], names=["kmer", "file_id"])

    return rows.mapInArrow(run, "kmer long, file_id int")


def occurrences(records: DataFrame, k: int = 31, invalid: str = "compat") -> DataFrame:
    """(file_id, n_windows): windows of each file, repeats included; from lengths alone where nothing is left out."""
    if invalid == "compat":
        return _prepared(records, k, invalid, "drop").groupBy("file_id").agg(F.sum(F.length("seq") - k + 1).cast("long").alias("n_windows"))
    return window_strings(records.select("file_id", "seq"), k, invalid).groupBy("file_id").agg(F.count("*").alias("n_windows"))
