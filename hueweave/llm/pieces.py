"""SentencePiece encoding and decoding by a shared-prefix Viterbi over a trie of the distinct marked words.

Distinct marked words (a run of word marks and what follows up to the next mark) are sorted; walking the sorted list
with the length of the prefix shared with the word before is a depth-first traversal of their trie, and the forward
states of the shared prefix are kept. For a unigram model the state of a prefix is its best score and last piece. For a
BPE model the best sum of scores is not what the library returns: there a prefix has exactly one last piece, the one
that merging leaves next to the last piece of what stands before it, so the forward step admits a piece only beside a
piece on its left with which it would not have merged. Both read a piece's admissible left states from shorter prefixes alone.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hueweave.llm.common import gather, released, slices, split_words

MARK = "▁"
#: Words kept from batch to batch, and the longest of these.
CACHE, CACHE_CHARS = 250_000, 48
#: Pairs of pieces remembered, and bytes of text encoded at once.
PAIRS, BYTES = 250_000, 2_000_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        self.kind, self.unk = kind, sp.unk_id()
        self.ids = {sp.id_to_piece(i): i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
        self._tails: dict[str, bool] = {}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that go on past a word's end: words of this model can't be encoded apart")
        back = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()} | {self.unk: " ⁇ ".encode()}
        self.raw = [back.get(i, b"") for i in n]

    def tails(self) -> dict[str, bool]:
        """Every ending of a piece, and whether it is one itself."""
        if not self._tails:
            self._tails = {p[i:]: False for p in self.scores for i in range(len(p))} | dict.fromkeys(self.scores, True)
        return self._tails

    def symbol(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character that is none."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes.get(b, self.unk) for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]


class WordEncoder:
    """Encodes sorted words by forward states along a trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.steps_of, self.beside, self.pairs = vocabulary, {}, {}, 0

    def steps(self, piece: str):
        """The merges that make `piece` alone: (score, its first symbol then, its last symbol then); None if they don't end in it."""
        if piece in self.steps_of:
            return self.steps_of[piece]
        parts, out, scores = list(piece), [], self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        self.steps_of[piece] = out if len(parts) == 1 else None
        return self.steps_of[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging `left + right` leaves just these two."""
        known = self.beside.get(left)
        if known is None:
            known = self.beside[left] = {}
        got = known.get(right)
        if got is None:
            if self.pairs > PAIRS:
                self.beside, self.pairs, known = {}, 0, {}
            self.pairs += 1
            got = known[right] = self._apart(left, right)
        return got

    def _apart(self, left: str, right: str) -> bool:
        a, b, scores = self.steps(left), self.steps(right), self.v.scores
        if a is None or b is None:
            return False
        i, j = 0, 0
        x, y = left[-1], right[0]
        while True:
            cross = scores.get(x + y)
            sa, sb = a[i][0] if i < len(a) else None, b[j][0] if j < len(b) else None
            if cross is not None and (sa is None or cross > sa) and (sb is None or cross >= sb):
                return False
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and sa >= sb):
                x, i = a[i][2], i + 1
            else:
                y, j = b[j][1], j + 1

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """words: distinct; each with its marks. Returns their ids."""
        ids, scores, tails, bpe, out, before = self.v.ids, self.v.scores, self.v.tails(), self.v.kind == "bpe", {}, ""
        last: list[str] = [""]  # of each prefix, the last piece
        forward: list[float] = [0.0]  # of each prefix, its score
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], forward[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # the pieces that end here, shortest first: no longer one if what stands here ends no piece
                start, starts = end - 1, []
                while start >= 0 and (known := tails.get(word[start:end])) is not None:
                    if known:
                        starts.append(start)
                    start -= 1
                if not starts or starts[0] != end - 1:
                    starts.insert(0, end - 1)  # a character that is no piece stands for itself
                best, score = "", float("-inf")
                if bpe:
                    for start in reversed(starts):
                        piece = word[start:end]
                        if self.apart(last[start], piece) if start else self.steps(piece) is not None:
                            best, score = piece, forward[start] + scores.get(piece, 0.0)
                            break
                else:
                    for start in starts:
                        piece = word[start:end]
                        if (s := forward[start] + scores.get(piece, -1e6)) > score:
                            best, score = piece, s
                last.append(best)
                forward.append(score)
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            parts.reverse()
            row = [*map(ids.get, parts)]
            out[word] = [i for p in parts for i in self.v.symbol(p)] if None in row else row
            before = word
        return out


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first mark; an empty text has none."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", (" " + text).replace(" ", MARK))]


class Encoder:
    """Whole texts to ids and back; what is kept between batches is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words, self.cache = vocabulary, WordEncoder(vocabulary), {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has; no nulls."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK)))
        words, at, offsets = split_words(pc.if_else(odd, "", texts))
        whole = {i: marked_words(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        cache = self.cache
        new = {w for own in (words, *whole.values()) for w in own if w not in cache}
        got = {w[1:]: struct.pack(f"<{len(ids)}i", *ids) for w, ids in self.words.encode([MARK + w for w in new]).items()}
        cache.update(got)
        parts, at = list(map(cache.__getitem__, words)), at.copy()
        # an empty text has no word; one with other runs of spaces is a part of its own
        bare = np.flatnonzero(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).tolist()
        for i, own in [*((i, []) for i in bare), *whole.items()]:
            at[offsets[i]] = len(parts)
            parts.append(b"".join(map(cache.__getitem__, own)))
        for w in got:
            if len(w) > CACHE_CHARS:
                del cache[w]
        if len(cache) > CACHE:
            self.cache = {}
        return gather(parts, "<i4", at, offsets)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", kind: str = "bpe", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded", most: int = BYTES) -> DataFrame:
    """docs with the piece ids of each whole text, how many they are, and the text decoded from them.

    Null text counts as empty: no ids, decoded empty. Columns of docs named like one of the three give way to it.
    Word marks within a text are decoded as spaces, as the library does. Nothing is shuffled; repeated rows stay.
    `most` bytes of text are encoded at once: more share more prefixes and hold more memory.
    """
    v = Vocabulary(path or model_path(), kind)
    kept = docs.drop(ids, count, decoded)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(count, T.IntegerType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(v)
        for whole in batches:
            for batch in slices(whole, at, most):
                values, sizes = own.encode(batch.column(at).fill_null(""))
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values))
                texts = pa.array([own.decode(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists.cast(pa.list_(pa.field("element", pa.int32(), False))), pa.array(sizes.astype(np.int32)), texts], names=[*batch.schema.names, ids, count, decoded])

    return kept.mapInArrow(released(run), schema)


def op2(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, most=8_000_000).drop("text")
