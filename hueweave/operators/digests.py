"""Sums of digests over all windows of sequences, by numpy over Arrow batches: no string is made of a window.

The digest of a string is the first 32 bits of its MD5. Sums are partial, a row a sequence or a piece of one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hueweave.functions.bases import ALPHABET
from hueweave.operators.kmers import _CODE, _pieces, _prepared, _rolled
from hueweave.operators.runs import _sliding_min

#: Bases that are held at once, and windows that are digested at once, so that their words stay in the cache.
BASES, LANES = 1 << 20, 32768
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(words: list[np.ndarray], size: int) -> np.ndarray:
    """The first 32 bits of the MD5 of strings of `size` bytes, 55 at most, of which column i of words has the bytes from 4 i on (little-endian, 0x80 after the last)."""
    out = np.empty(len(words[0]), np.uint32)
    for at in range(0, len(out), LANES):
        m = [w[at : at + LANES] for w in words]
        a, b, c, d = (np.full(len(m[0]), s, np.uint32) for s in _START)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            kind, g = i >> 4, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i >> 4] & 15
            if kind == 0:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif kind == 1:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif kind == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            f += a
            f += np.uint32((_SINES[i] + (8 * size if g == 14 else 0)) & 0xFFFFFFFF)
            if g < len(m):
                f += m[g]
            turn = _TURNS[kind][i & 3]
            np.right_shift(f, np.uint32(32 - turn), out=t)
            np.left_shift(f, np.uint32(turn), out=f)
            np.bitwise_or(f, t, out=f)
            f += b
            a, b, c, d, f = d, f, b, c, a  # the oldest array is written next
        out[at : at + LANES] = (a + np.uint32(_START[0])).byteswap()
    return out


def _words(letters: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of words, as md5_heads takes them, of all k-windows of the letters."""
    n = len(letters) - k + 1
    x = np.concatenate((letters, np.zeros(4, np.uint8))).astype(np.uint32)
    four = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    left = k % 4
    whole = [four[4 * j : 4 * j + n] for j in range(k // 4)]
    return [*whole, four[k - left : k - left + n] & np.uint32((1 << 8 * left) - 1) | np.uint32(0x80 << 8 * left)]


def window_sums(records: DataFrame, id_col: str, span: int, names: list[str], work: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(id, n, sums): windows of `span` bases of each sequence, and the sums of what work makes of each window of a string of bases (bytes)."""
    rows = _prepared_any(records, span).select(id_col, "seq")

    def settle(ids: list, seqs: list[bytes]) -> pa.RecordBatch:
        letters = np.frombuffer(b"".join(seqs), np.uint8)
        size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        at = np.cumsum(size) - size
        n = size - span + 1
        # windows that reach into the next sequence count for none
        cuts = np.stack((at, at + n), axis=1).reshape(-1)
        sums = [np.add.reduceat(np.concatenate((v.astype(np.int64), np.zeros(span, np.int64))), cuts)[::2] for v in work(letters)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n), *map(pa.array, sums)], names=[id_col, "n", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, held = [], [], 0
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(s, span):
                    ids.append(i)
                    seqs.append(piece.encode("ascii"))
                    held += len(piece)
                    if held >= BASES:
                        yield settle(ids, seqs)
                        ids, seqs, held = [], [], 0
            if seqs:
                yield settle(ids, seqs)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema[id_col].dataType)
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], *(T.StructField(x, T.LongType()) for x in ("n", *names))]))


def _prepared_any(records: DataFrame, span: int) -> DataFrame:
    """Sequences of `span` bases or more; windows of an odd number skip invalid characters as everywhere, others hold ACGT only."""
    return _prepared(records, span, "compat", "drop") if span % 2 else records.where(f"length(seq) >= {span}")


def minimizer_sums(records: DataFrame, id_col: str, k: int, m: int = 7) -> DataFrame:
    """(id, n, minimizer, canonical): digests of each window's least m-mer, and of its least one on either strand."""
    table = np.array([int(hashlib.md5("".join(x).encode()).hexdigest()[:8], 16) for x in itertools.product(ALPHABET, repeat=m)], np.int64)

    def work(letters: np.ndarray) -> list[np.ndarray]:
        c = _CODE[letters].astype(np.int64)
        one, two = _rolled(c, m, False), _rolled(3 - c, m, True)
        return [table[_sliding_min(x.astype(np.int32), k - m + 1)] for x in (one, np.minimum(one, two))]

    return window_sums(records, id_col, k, ["minimizer", "canonical"], work)


def slide_sums(records: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, n, appended, prepended, rc): digests for each k-mer and the base after it: of the k-mer that appending the base gives, of the one that prepending it gives, and of the k-mer's reverse complement."""
    other = np.zeros(256, np.uint8)
    other[list(b"ACGT")] = list(b"TGCA")

    def work(letters: np.ndarray) -> list[np.ndarray]:
        n = len(letters) - k
        heads = md5_heads(_words(letters, k), k)
        back = md5_heads(_words(other[letters[::-1]], k), k)[::-1]
        # the base after the k-mer, then all bases of it but the last: words of a string that starts one base earlier, the first base replaced
        x = [w[:n].copy() for w in _words(np.concatenate((letters[:1], letters)), k)]
        x[0] = x[0] & np.uint32(0xFFFFFF00) | letters[k : k + n].astype(np.uint32)
        return [heads[1:], md5_heads(x, k), back[:n]]

    return window_sums(records, id_col, k + 1, ["appended", "prepended", "rc"], work)
