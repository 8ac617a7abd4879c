"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A text is cut in passages of PASSAGE UTF-8 bytes; each is encoded by the square roots of the shares of its bytes, of
the transitions between kinds of bytes and of the 8-byte sequences that repeat within it. A gated attention (tanh x sigmoid) weighs the encoded passages, their weighted sum is
the document, a logistic layer scores it. Only document labels are used; they train every layer at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import arrow_map, local_table, released, slices, texts_of

PASSAGE = 512
#: At most so many labelled rows train the model: those with the smallest hash of their id.
SAMPLE = 4_000
#: And of these, in the same order, at most as many as have so many passages in all (64 MB of features on the driver).
PASSAGES = 100_000
KINDS = 8


def _kinds() -> np.ndarray:
    """Kind of each byte: letters by case, digit, space, line end, inner punctuation, other ASCII, non-ASCII."""
    k = np.full(256, 6, np.int64)
    k[128:] = 7
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:'\"-")):
        k[list(chars)] = i
    return k


def _distinct(grams: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Distinct sequences of each passage, for texts of so many passages that a number of one and a sequence don't fit a word."""
    cuts = np.searchsorted(own[: len(grams)], np.arange(n + 1))
    return np.array([len(np.unique(grams[s:e])) for s, e in zip(cuts[:-1], cuts[1:], strict=True)])


WIDTH = 256 + KINDS * KINDS + 1


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH features, passages of each text); an empty text is one passage without bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw])
    out, kinds, at = np.zeros((sizes.sum(), WIDTH), np.float32), _kinds(), 0
    for r, n in zip(raw, sizes.tolist(), strict=True):
        if r:
            b = np.frombuffer(r, np.uint8).astype(np.int64)
            own = np.arange(len(b)) // PASSAGE
            out[at : at + n, :256] = np.bincount(own * 256 + b, minlength=n * 256).reshape(n, 256)
            two = kinds[b[:-1]] * KINDS + kinds[b[1:]]
            out[at : at + n, 256:-1] = np.bincount(own[:-1] * KINDS**2 + two, minlength=n * KINDS**2).reshape(n, -1)
            if len(b) >= 8:
                grams = np.ndarray((len(b) - 7,), "<u8", r, strides=(1,)) >> np.uint64(12)
                mine = own[: len(grams)].astype(np.uint64)
                new = np.unique(grams ^ (mine << np.uint64(52)))
                seen = np.bincount((new >> np.uint64(52)).astype(np.int64), minlength=n)[:n] if n <= 4096 else _distinct(grams, own, n)
                out[at : at + n, -1] = 1 - np.minimum(1, seen / np.maximum(1, np.bincount(own[: len(grams)], minlength=n)))
        at += n
    out[:, :256] /= np.maximum(out[:, :256].sum(1, keepdims=True), 1)
    out[:, 256:-1] /= np.maximum(out[:, 256:-1].sum(1, keepdims=True), 1)
    return np.sqrt(out), sizes


class AttentionModel:
    """Weights as plain arrays: E encodes, V and U gate, w attends, c and b classify."""

    def __init__(self, hidden: int = 24, gates: int = 12, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"E": draw(WIDTH, hidden), "e": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates), "w": draw(gates), "c": draw(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        p, starts = self.p, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = (v * u) @ p["w"]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        a = np.exp(a - np.maximum.reduceat(a, starts)[doc])
        a = a / np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "s": s, "doc": doc, "starts": starts}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 2) -> AttentionModel:
        """Adam on the mean log loss, in batches of whole documents in a fixed order."""
        rng, ends = np.random.default_rng(seed), np.cumsum(sizes)
        m, q = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.choice(len(y), min(batch, len(y)), replace=False)
            rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in pick])
            for k, g in self.gradient(x[rows].astype(np.float64), sizes[pick], y[pick]).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                self.p[k] -= rate * min(1, 2 - 2 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, sizes)
        h, v, u, a, doc, starts = f["h"], f["v"], f["u"], f["a"], f["doc"], f["starts"]
        ds = (f["s"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[doc] * h).sum(1)
        da = a * (da - np.add.reduceat(a * da, starts)[doc])
        dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz[doc] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "c": f["z"].T @ ds, "b": np.array([ds.sum()])}

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        out = []
        for at in range(0, len(texts), 256):
            x, sizes = encode(texts[at : at + 256])
            out.append(self.forward(x, sizes)["s"])
        # the last bits of a product of matrices depend on the other rows of the batch; equal texts have equal scores
        return np.round(np.concatenate(out), 12)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> AttentionModel:
    """A model of the labelled rows outside the held-out fold; `sample` and `passages` bound how many (of smallest hash of the id).

    Repeated labels of an id count once (the smaller), and so do rows of an id (the shortest text, then the smallest hash).
    Null labels are left out, null texts are empty. Without both classes, empty tables included, the model is untrained.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).cast("long")
    listed = own.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(size.alias("n"), F.xxhash64("text").alias("h"))).alias("k"))
    held, picked = 0, []
    for r in sorted(listed.select("id", "y", "k.n", "k.h", F.xxhash64("id").alias("o")).collect(), key=lambda r: (r.o, r.id)):  # `sample` rows at most
        held += r.n
        if held > passages:
            break
        picked.append((r.id, r.y, r.h))
    if len({y for _, y, _ in picked}) < 2:
        return AttentionModel()
    named = local_table(docs.sparkSession, picked, f"id {chosen.schema['id'].dataType.simpleString()}, y int, h long")
    once = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(named), ["id", "h"]).groupBy("id", "y").agg(F.first("text").alias("text"))

    def work(c: dict) -> dict:
        return {"id": c["id"], "y": c["y"], "x": pa.array([encode([t])[0].astype("<f2").tobytes() for t in texts_of(c["text"])], pa.binary())}

    rows = sorted(arrow_map(once.select("id", "y", "text"), work, "id long, y int, x binary").collect())
    bags = [np.frombuffer(r.x, "<f2").reshape(-1, WIDTH) for r in rows]
    return AttentionModel().fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r.y for r in rows], np.float64))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, whole texts. Null text counts as empty; a null id is in no held-out fold."""

    def work(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "score": model.score(texts_of(c["text"]))}

    got = arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, score double")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs, all columns, without the rows that score under the threshold.

    Null and empty texts are scored as empty; null ids, repeated rows and columns of any name make no difference, as only
    the text is read. An empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(model.score(texts_of(batch.column(at))) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
