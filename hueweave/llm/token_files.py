"""Token ids in Arrow IPC files of fixed-size lists: equal-length sequences and masks, read in place by number.

A mask is a fixed-size list of booleans, which Arrow keeps as bits; it is handed out as those bits, so nothing is copied.

A corpus is written as files of ascending, disjoint id ranges. Each holds record batches with `ids` and `mask` as
fixed-size lists of `length`, and beside it an index file with the id, first token and token count of each document.
Only the last sequence of a file is padded. Files appear under their name only when complete, and a task that runs
twice writes the same file twice, so lost executors leave nothing half written.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import cut, gather, released, shared_dir, split_words
from hueweave.operators.running import running_sum

#: What may follow letters without joining them, and the characters that stand for bytes that aren't printable in Latin-1.
PUNCTUATION = ".,;:!?*$%&#"
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: White space for Python or for the tokenizers library, for RE2.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Words kept from batch to batch, and the longest of these; sequences in a record batch.
CACHE, CACHE_CHARS, SEQUENCES = 600_000, 48, 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """The tokenizers library on distinct words of texts.

    The pre-tokenizer of a byte-level BPE always cuts between a non-space and a space and before the last space of a
    run that a non-space follows, and looks no further back, so words with the space before them encode apart to the ids
    of the whole text (texts with other runs of spaces are encoded whole). Each distinct word is encoded once, most of
    them strung together in one call whose ids are then told apart by their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.kind = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.sizes = np.zeros(max(self.t.get_vocab(with_added_tokens=True).values()) + 1, np.int64)  # bytes of each id: one character stands for one byte
        for piece, i in self.t.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(piece)
        for i, added in self.t.get_added_tokens_decoder().items():
            self.sizes[i] = len(added.content.encode())

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; no nulls."""
        odd = pc.match_substring_regex(texts, f"{SPACE} (?:{SPACE}|\\z)")  # runs of spaces that are not cut before their last
        words, at, offsets = split_words(pc.if_else(odd, "", texts))
        cache = self.cache
        new = self._plain([w for w in words if w not in cache])
        alone = [w for w in new if w[-1:].isspace() or not w]
        self._single(alone)
        if alone:
            held = set(alone)
            self._strung([w for w in new if w not in held])
        else:
            self._strung(new)
        parts, at = list(map(cache.__getitem__, words)), at.copy()
        for w in words:
            if len(w) > CACHE_CHARS:
                cache.pop(w, None)
        if len(cache) > CACHE:
            self.cache, self.marks = {}, {}
        # the first word of a text has no space before it
        firsts = [words[i] for i in at[offsets[:-1]].tolist()]
        at[offsets[:-1]] = len(parts) + np.arange(len(firsts))
        parts += self._library(firsts)
        ids, sizes = gather(parts, self.kind, at, offsets)
        raw, ends = ids.tobytes(), np.cumsum(sizes) * ids.itemsize
        out = [raw[e - n : e] for e, n in zip(ends.tolist(), (sizes * ids.itemsize).tolist(), strict=True)]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, own in zip(whole, self._library([texts[i].as_py() for i in whole]), strict=True):
            out[i] = own
        return out

    def _plain(self, words: list[str]) -> list[str]:
        """Caches words of Latin letters, with or without punctuation after them; returns the rest.

        A space and letters are one unit of the pre-tokenizer and so is the punctuation, so both go straight to the model.
        """
        cache, tokenize, rest, pack = self.cache, self.t.model.tokenize, [], "H" if self.kind == "<u2" else "I"
        for w in words:
            base = w.rstrip(PUNCTUATION)
            if not base.isalpha() or len(w) > CACHE_CHARS or (not base.isascii() and max(base) > "\u024f"):
                rest.append(w)
                continue
            own = cache.get(base)
            if own is None:
                ids = [x.id for x in tokenize("Ġ" + (base if base.isascii() else base.encode().decode("latin-1").translate(BYTE_CHARS)))]
                own = cache[base] = struct.pack(f"<{len(ids)}{pack}", *ids)
            if len(base) < len(w):
                mark = w[len(base) :]
                if mark not in self.marks:
                    self.marks[mark] = self._library([mark])[0]
                cache[w] = own + self.marks[mark]
        return rest

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, words: list[str]) -> None:
        self.cache.update(zip(words, self._library([" " + w for w in words]), strict=True))

    def _strung(self, words: list[str]) -> None:
        for at in range(0, len(words), 5_000):
            own = words[at : at + 5_000]
            ids = np.array(self.t.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum(self.sizes[ids])
            sizes = pc.binary_length(pa.array(own)).to_numpy() + 1
            cuts = (np.searchsorted(ends, np.cumsum(sizes)) + 1) * ids.itemsize
            raw, start = ids.tobytes(), 0
            for w, end in zip(own, cuts.tolist(), strict=True):
                self.cache[w] = raw[start:end]
                start = end


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path


#: Tasks that write, at most; what a task gets beyond the rows of a file goes to further files of its own.
BUCKETS = 10_000


class Ranges:
    """Buckets of ascending ids: about even shares of the rows, and of an id with more rows than a file holds, lots by the hash of the text.

    Null ids come first, as one such id if there are many. Rows of one id and text stay together.
    """

    def __init__(self, docs: DataFrame, per_file: int, most: int = BUCKETS):
        self.bounds, self.lots = np.empty(0, np.int64), {}
        n = docs.count()
        buckets = max(1, min(most, -(-n // per_file)))
        if buckets > 1:
            at = docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
            self.bounds = np.unique(np.array(at, np.float64)).astype(np.int64)
            share = max(per_file, n // most)
            often = docs.groupBy("doc_id").count().where(F.col("count") > share).collect()  # at most n / share, so `most`
            self.lots = {r.doc_id: -(-r[1] // share) for r in often}
        self.hot = np.array(sorted(i for i in self.lots if i is not None), np.int64)
        # an id of several lots has a range of its own, so that its lots stand in order between those below and above
        self.bounds = np.unique(np.concatenate((self.bounds, self.hot, self.hot - 1))) if len(self.hot) else self.bounds
        room = np.ones(len(self.bounds) + 1, np.int64)
        for i in self.hot.tolist():
            room[np.searchsorted(self.bounds, i)] = self.lots[i]
        self.first = np.cumsum(room) - room + self.lots.get(None, 1)

    def buckets(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The bucket of each row; hashes are longs."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy()
        out = self.first[np.searchsorted(self.bounds, values)]
        part = lambda k: ((hashes.view(np.uint64) >> np.uint64(33)) * np.uint64(k) >> np.uint64(31)).astype(np.int64)  # noqa: E731 the k-th share of all hashes
        for i in self.hot[np.isin(self.hot, values)].tolist():
            mine = (values == i) & ~null
            out[mine] += part(self.lots[i])[mine]
        return np.where(null, part(self.lots.get(None, 1)), out)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 2048, per_file: int = 4096) -> DataFrame:
    """Writes ids of whole texts, `end_id` after each, in ascending id order; returns (bucket, part, path, n_docs, n_tokens), one row a file.

    Null text: the end id alone. Rows with a null id come first. Rows of one id stay, in the order of a hash of their texts, then
    of their ids' bytes. An empty table writes no file. Other columns are not read. A file holds `per_file` documents and
    what goes on in its last batch at most; a task writes as many as it needs.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges, model = Ranges(own.select("doc_id"), per_file), path or tokenizer_path()
    # the upper bits decide the lot of a hot id, so rows sorted by the unsigned hash stand in the order of lots
    own = own.withColumn("h", F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(model)
        end = np.array([end_id], encoder.kind).tobytes()
        for whole in batches:
            step = max(1, int(whole.num_rows * 8_000_000 / max(1, whole.nbytes)))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                ids = batch.column(0)
                order = batch.column(2).to_numpy()
                bucket = ranges.buckets(ids, order ^ np.int64(-(1 << 63)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), ids, batch.column(2), pa.array([x + end for x in encoder.encode(batch.column(1).fill_null(""))], pa.binary())], names=["bucket", "doc_id", "h", "ids"])

    if length % 8:
        raise ValueError("a sequence's mask is whole bytes: its length must be a multiple of 8")
    wide = 2 if _vocabulary(model) <= 1 << 16 else 4

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Writer | None = None
        done = []
        for batch in batches:
            for bucket, doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if out is None or out.bucket != bucket or out.docs >= 2 * per_file:
                    if out:
                        done.append(out.close())
                    part = out.part + 1 if out and out.bucket == bucket else 0
                    out = _Writer(folder, bucket, part, length, wide)
                out.add(doc, raw.as_buffer())
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["bucket", "part", "path", "n_docs", "n_tokens"])

    dealt = own.mapInArrow(released(tokens), "bucket int, doc_id long, h long, ids binary").repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "h", "ids")
    return cut(dealt.mapInArrow(released(write), "bucket int, part int, path string, n_docs long, n_tokens long"))


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class _Writer:
    """One file and its index, streamed in batches of SEQUENCES sequences."""

    def __init__(self, folder: str, bucket: int, part: int, length: int, wide: int):
        self.fs, base = _store(folder)
        self.fs.create_dir(base, recursive=True)
        self.bucket, self.part, self.length, self.kind = bucket, part, length, f"<u{wide}"
        self.path, self.temp = f"{base}/part-{bucket:06d}-{part:06d}.arrow", f"{base}/.{uuid.uuid4().hex}"
        item = pa.uint16() if wide == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(self.temp), self.fs.open_output_stream(f"{self.temp}-index")]
        self.files = [ipc.new_file(self.sinks[0], self.schema), ipc.new_file(self.sinks[1], self.index_schema)]
        self.held, self.size, self.rows, self.at, self.docs = [], 0, [], 0, 0

    def add(self, doc: int | None, raw) -> None:
        ids = np.frombuffer(raw, self.kind)
        self.rows.append((doc, self.at, len(ids)))
        self.held.append(ids)
        self.at, self.size, self.docs = self.at + len(ids), self.size + len(ids), self.docs + 1
        if self.size >= SEQUENCES * self.length:
            self.flush(False)
        if len(self.rows) >= 8192:
            self.index()

    def flush(self, last: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        per = SEQUENCES * self.length  # every batch but the last is full, so that numbers lead to batches
        full = len(values) if last else len(values) // per * per
        rows = -(-full // self.length)
        for i in range(0, rows, SEQUENCES):
            part = values[i * self.length : min(full, (i + SEQUENCES) * self.length)]
            n = -(-len(part) // self.length)
            mask = np.zeros(n * self.length, bool)
            mask[: len(part)] = True
            padded = np.zeros(n * self.length, self.kind)
            padded[: len(part)] = part
            self.files[0].write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.size = [values[full:]], len(values) - full

    def index(self) -> None:
        self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], pa.int64()) for i in range(3)], schema=self.index_schema))
        self.rows = []

    def close(self) -> tuple[int, int, str, int, int]:
        self.flush(True)
        self.index()
        for x in (*self.files, *self.sinks):
            x.close()
        self.fs.move(f"{self.temp}-index", f"{self.path}-index")
        self.fs.move(self.temp, self.path)
        return self.bucket, self.part, self.path, self.docs, self.at


class TokenFile:
    """Random access to the sequences of one file; on a local or mounted store nothing is copied."""

    def __init__(self, path: str, folder: str):
        fs, _ = _store(folder)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.file, self.index = ipc.open_file(opened(path)), ipc.open_file(opened(f"{path}-index"))
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        """Batch i; the last one is held, as asking the reader for it again costs more than all else."""
        if i != self.at:
            self.at, self.batch = i, self.file.get_batch(i)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, both as views of the file; the mask in bytes of eight tokens, the first in the lowest bit."""
        batch, at = self._batch(i // SEQUENCES), i % SEQUENCES
        ids, mask = batch.column(0), batch.column(1).values
        bits = np.frombuffer(mask.buffers()[1], np.uint8)
        step = self.length // 8
        start = mask.offset // 8 + at * step
        return ids.values.to_numpy()[at * self.length : (at + 1) * self.length], bits[start : start + step]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids from number `start` on."""
        parts, per = [], SEQUENCES * self.length
        while n > 0:
            values = self._batch(start // per).column(0).values.to_numpy()
            parts.append(values[start % per : start % per + n])
            if not len(parts[-1]):
                raise ValueError("tokens beyond the end of the file")
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for i in range(self.index.num_record_batches):
            b = self.index.get_batch(i)
            yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back; start counts from the first file's first id.

    Where files start is summed up over ranges of them.
    """
    summed = running_sum(files.select("bucket", "part", "path", "n_tokens"), ["bucket", "part"], F.col("n_tokens"), "end")
    placed = cut(summed.select("path", (F.col("end") - F.col("n_tokens")).alias("before")))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, rows = TokenFile(path, folder), []
                for doc, start, n in file.documents():
                    rows.append((doc, before + start, n, zlib.crc32(file.tokens(start, n).astype("<u4"))))
                    if len(rows) == 8192:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, min(BUCKETS, placed.count())), "path").mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    return read_token_files(write_token_files(docs, folder), folder)
