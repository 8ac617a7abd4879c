"""Column functions on bases, k-mers, colours and file names.

A k-mer is a string over ACGT or a long of two bits a base, the first base most significant, so the order of longs is
the order of strings. K is odd and at most 31. A colour is a long with bit i for file i (63 files at most) or a sorted
array of file ids; as text it is one character a file, file 0 first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "ACGT"
MAX_K, MAX_MASK_FILES = 31, 63


def check_k(k: int) -> int:
    if k < 1 or k > MAX_K or k % 2 == 0:
        raise ValueError(f"k must be odd and from 1 to {MAX_K}, not {k}")
    return k


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# bases ---------------------------------------------------------------------------------------------------------------


def base_encode(base: Column | str) -> Column:
    """A, C, G, T to 0..3; null for anything else, lower case included."""
    b = _c(base)
    return F.when(b.isin(*ALPHABET), F.ascii(F.translate(b, ALPHABET, "0123")) - 48)


def base_decode(code: Column | str) -> Column:
    """0..3 to A, C, G, T; larger codes count modulo 4."""
    return F.substr(F.lit(ALPHABET), F.pmod(_c(code), F.lit(4)).cast("int") + 1, F.lit(1))


def alphabet() -> Column:
    """The codes in the order in which extensions are tried."""
    return F.array(*(F.lit(i) for i in range(4)))


def strip_invalid(seq: Column | str) -> Column:
    return F.regexp_replace(_c(seq), "[^ACGT]", "")


def effective_sequence(seq: Column | str, k: int) -> Column:
    """The sequence whose windows are enumerated when invalid characters are skipped: each invalid character among the
    first k leaves an A in front, all others vanish, so that windows reach across them. Null if seq is shorter than k."""
    s = _c(seq)
    bad = F.length(F.regexp_replace(F.substring(s, 1, k), "[ACGT]", ""))
    return F.when(F.length(s) >= k, F.concat(F.expr("repeat('A', 0)") if k == 0 else F.repeat(F.lit("A"), bad), strip_invalid(s)))


# k-mers as strings ---------------------------------------------------------------------------------------------------


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def canonical(kmer: Column | str) -> Column:
    return F.least(_c(kmer), revcomp(kmer))


def is_canonical(kmer: Column | str) -> Column:
    return _c(kmer) < revcomp(kmer)


def append(kmer: Column | str, base: Column | str) -> Column:
    """Slide right by one base."""
    return F.concat(F.expr("substr({0}, 2)".format(kmer)) if isinstance(kmer, str) else F.substr(kmer, F.lit(2)), _c(base))


def prepend(kmer: Column | str, base: Column | str) -> Column:
    """Slide left by one base."""
    k = _c(kmer)
    return F.concat(_c(base), F.substr(k, F.lit(1), F.length(k) - 1))


def successors(kmer: Column | str) -> Column:
    """The four k-mers one base to the right, by A, C, G, T."""
    return F.array(*(append(kmer, F.lit(b)) for b in ALPHABET))


def predecessors(kmer: Column | str) -> Column:
    return F.array(*(prepend(kmer, F.lit(b)) for b in ALPHABET))


# k-mers as longs -----------------------------------------------------------------------------------------------------


def kmer_encode(kmer: Column | str) -> Column:
    return F.conv(F.translate(_c(kmer), "ACGT", "0123"), 4, 10).cast("long")


def kmer_decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def extend_code(code: Column | str, base: Column | str) -> Column:
    """One base more on the right, no base lost."""
    return F.shiftleft(_c(code), 2).bitwiseOR(_c(base).cast("long"))


def append_code(code: Column | str, base: Column | str, k: int) -> Column:
    return extend_code(code, base).bitwiseAND(F.lit((1 << 2 * k) - 1).cast("long"))


def prepend_code(code: Column | str, base: Column | str, k: int) -> Column:
    return F.shiftright(_c(code), 2).bitwiseOR(F.shiftleft(_c(base).cast("long"), 2 * (k - 1)))


#: The halves that change places when groups of 2, 4, 8, 16 and 32 bits are swapped.
SWAPS = (0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF)


def revcomp_code(code: Column | str, k: int) -> Column:
    """Swap the two-bit groups of a complemented word, then drop what is unused."""
    x = F.bitwise_not(_c(code))
    for shift, mask in zip((2, 4, 8, 16, 32), SWAPS, strict=True):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical_code(code: Column | str, k: int) -> Column:
    return F.least(_c(code), revcomp_code(code, k))


def minimizer(kmer: Column | str, m: int = 7) -> Column:
    """The least m-mer of a k-mer."""
    k = _c(kmer)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(k) - m + 1), lambda i: F.substr(k, i, F.lit(m))))


def minimizer_code(code: Column | str, k: int, m: int = 7) -> Column:
    """The least canonical m-mer of a k-mer as a long: neighbours mostly share it, on either strand."""
    c, mask = _c(code), F.lit((1 << 2 * m) - 1).cast("long")
    shifts = F.array(*(F.lit(2 * i) for i in range(k - m + 1)))
    least = lambda x: F.array_min(F.transform(shifts, lambda i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(mask)))
    return F.array_min(F.transform(F.array(c, revcomp_code(c, k)), least))


def revcomp_codes(x: np.ndarray, k: int) -> np.ndarray:
    """revcomp_code of an array of longs; k may be even here."""
    y = ~x.astype(np.uint64)
    for shift, mask in zip((2, 4, 8, 16, 32), SWAPS, strict=True):
        s, m = np.uint64(shift), np.uint64(mask)
        y = y >> s & m | (y & m) << s
    return (y >> np.uint64(64 - 2 * k)).astype(np.int64)


# packed bytes --------------------------------------------------------------------------------------------------------


def packed_size(length: Column | str) -> Column:
    """Bytes of a packed string: four bases a byte."""
    return F.ceil(_c(length) / 4).cast("long")


def kmers_in(seq: Column | str, k: int) -> Column:
    return (F.length(_c(seq)) - k + 1).cast("long")


_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def pack_one(seq: str) -> bytes:
    """Four bases a byte, the first in the low bits; the last byte is filled up with zeros."""
    codes = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    if (codes == 255).any():
        raise ValueError("only A, C, G and T can be packed")
    quads = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    quads[: len(codes)] = codes
    return (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


def unpack_one(packed: bytes, length: int) -> str:
    quads = (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.frombuffer(ALPHABET.encode(), np.uint8)[quads.reshape(-1)[:length]].tobytes().decode()


@F.pandas_udf(T.BinaryType())
def pack(seq: pd.Series) -> pd.Series:
    return seq.map(pack_one, na_action="ignore")


@F.pandas_udf(T.StringType())
def unpack(packed: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or n is None else unpack_one(p, int(n)) for p, n in zip(packed, length, strict=True)], dtype=object)


# colours -------------------------------------------------------------------------------------------------------------


def color_string(mask: Column | str, n_files: int) -> Column:
    """One character a file, file 0 first."""
    return F.reverse(F.lpad(F.bin(_c(mask)), n_files, "0"))


def color_mask(text: Column | str) -> Column:
    """Any character but 0 counts as set; 63 characters at most."""
    return F.conv(F.reverse(F.regexp_replace(_c(text), "[^0]", "1")), 2, 10).cast("long")


def padded_color(text: Column | str) -> Column:
    """Filled up with 0 to whole bytes."""
    t = _c(text)
    return F.rpad(t, (F.ceil(F.length(t) / 8) * 8).cast("int"), F.lit("0"))


def color_files(mask: Column | str, n_files: int) -> Column:
    """The sorted ids of the files of a mask."""
    m = _c(mask)
    return F.filter(F.sequence(F.lit(0), F.lit(n_files - 1)), lambda i: F.call_function("getbit", m, i) == 1)


def files_color(file_ids: Column | str, n_files: int) -> Column:
    """The text of a colour from the sorted ids of its files, for any number of files."""

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        out = []
        for ids in lists:
            bits = np.full(n_files, ord("0"), np.uint8)
            bits[np.asarray(ids, np.int64)] = ord("1")
            out.append(bits.tobytes().decode())
        return pd.Series(out, dtype=object)

    return text(_c(file_ids))


def set_id(file_ids: Column | str) -> Column:
    """A 64-bit id of a set of files: the exclusive or of the hashes of its ids."""
    return F.aggregate(_c(file_ids), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(x.cast("int"))))


def popcount(mask: Column | str) -> Column:
    return F.bit_count(_c(mask)).cast("int")


def popcount_text(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(text), "[^1]", ""))


# file names ----------------------------------------------------------------------------------------------------------


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def short_name(path: Column | str) -> Column:
    """The base name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)
