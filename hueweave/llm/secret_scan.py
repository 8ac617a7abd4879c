"""Secret scans: patterns find candidates, a random forest removes the false positives.

Features of a candidate: length, transitions between kinds of characters, how much of it words of a dictionary counted from
the documents cover, whether it stands in a path or an address, and the words around it. The forest is trained here from
labelled findings, a bounded list; `labelled_findings` plants one into snippets of the documents where none is given.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hueweave.llm.common import arrow_map, cut, released, sampled_texts, slices

#: Words of the dictionary at most, the texts that a word must be in, and its letters.
DICTIONARY, LEAST, LETTERS = 50_000, 3, (4, 20)
#: Snippets of documents into which labelled findings are planted, and their characters.
SNIPPETS, SNIPPET = 500, 400
NAMES = r"api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|private[_-]?key|auth[_-]?token|access[_-]?token|token|secret|password|passwd|pwd|credentials?"
#: name -> pattern with the candidate as its only group; the same text serves RE2 as a filter of whole texts.
PATTERNS = {
    "assigned": rf"(?i)(?:{NAMES})[\"']?[ \t]*(?:=|:|=>|:=)[ \t]*[\"']?([^\s\"',;<>]{{8,}})",
    "cloud key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "prefixed": r"\b((?:gh[pousr]_|glpat-|sk-|sk_live_|xox[abpr]-|AIza|npm_|pypi-)[A-Za-z0-9_-]{16,})",
    "web token": r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "private key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)",
    "bearer": r"(?i)\b(?:bearer|basic) ([A-Za-z0-9._~+/-]{16,}=*)",
    "in address": r"[a-z][a-z0-9+.-]{0,20}://[^\s:/@]+:([^\s:/@]{4,})@",
    "random": r"([A-Za-z0-9+/_=-]{24,})",
}
TRIGGERS = ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials", "login", "export")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "revision", "uuid", "guid", "id", "example", "sample", "dummy", "placeholder", "fake", "etag", "integrity", "blob", "image")
SURE = ("cloud key", "web token", "private key")


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, least: int = LEAST) -> frozenset[str]:
    """The words a-z that the most texts hold, counted over all documents: all that are in as many texts as leaves `most` words at most.

    The driver sees how many words there are of each count, then the words; no partition sorts its words for it.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+"))).alias("w"))
    counts = cut(words.where(F.length("w").between(*LETTERS)).groupBy("w").count().where(F.col("count") >= least))
    # counts from the powers of two downwards tell the range, then the counts within it the bound
    level = F.floor(F.log2("count")).cast("int")
    bound = _bound(counts.groupBy(level.alias("c")).agg(F.count("*").alias("n")).collect(), most)
    if bound is None:
        return frozenset()
    exact, room = 1 << bound[0], most - bound[1]
    if bound[2] > room:  # the last level fits in part
        near = counts.where(level == bound[0]).groupBy(F.col("count").alias("c")).agg(F.count("*").alias("n"))
        step = F.floor((F.col("c") - exact) * 1024 / F.lit(exact)).cast("long")  # at most 1024 counts or ranges of counts
        part = _bound([r for r in near.groupBy(step.alias("c")).agg(F.sum("n").alias("n")).collect()], room, whole=True)
        exact = -(-exact * (1024 + (1024 if part is None else part[0])) // 1024)
    return frozenset(r.w for r in counts.where(F.col("count") >= exact).select("w").collect())


def _bound(rows: list, most: int, whole: bool = False) -> tuple[int, int, int] | None:
    """The lowest c, from the highest down, up to which the sum of n stays within `most`, or that first exceeds it; with (sum above it, its own n). `whole`: only those within."""
    above, out = 0, None
    for r in sorted(rows, key=lambda r: -r.c):
        if whole and above + r.n > most:
            break
        out = (int(r.c), above, int(r.n))
        above += r.n
        if above > most:
            break
    return out


def snippets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SNIPPETS, size: int = SNIPPET) -> list[str]:
    """Pieces from the midst of texts of n ids, those of smallest hash; what labelled findings stand between."""
    some = sampled_texts(docs.where(F.length(text_col) >= 2 * size), n, id_col, text_col)
    return [r.s for r in sorted(some.select("h", F.expr(f"substr(text, length(text) div 4 + 1, {size})").alias("s")).collect())]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates, each span once, by the first pattern that finds it; they may overlap."""
    out: dict[tuple[int, int], str] = {}
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            if kind == "random" and not (re.search(r"\d", m[1]) and re.search(r"[A-Za-z]", m[1])):
                continue
            out.setdefault(m.span(1), kind)
    return sorted((s, e, kind) for (s, e), kind in out.items())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def covered(letters: str, words: frozenset[str]) -> int:
    """Letters of a run that dictionary words cover, the longest word first from the left."""
    at, n = 0, 0
    while at < len(letters):
        for end in range(min(len(letters), at + LETTERS[1]), at + LETTERS[0] - 1, -1):
            if letters[at:end] in words:
                n, at = n + end - at, end
                break
        else:
            at += 1
    return n


def features(text: str, start: int, end: int, kind: str, words: frozenset[str] = frozenset()) -> list[float]:
    own, before, after = text[start:end], text[max(0, start - 120) : start], text[end : end + 60]
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in own]
    n = max(1, len(own))
    changes = Counter(zip(kinds[:-1], kinds[1:], strict=True))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(own).values())
    bare = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", own).lower())
    known = sum(covered(w, words) for w in bare)
    left = re.findall(r"[a-z0-9]+", before.lower())[-6:]
    right = re.findall(r"[a-z0-9]+", after.lower())[:4]
    glued = re.search(r"[^\s\"'=:<>]*$", before)[0]
    vowels = sum(c in "aeiouAEIOU" for c in own)
    letters = sum(c.isalpha() for c in own)
    return [
        len(own), len(set(own)) / n, entropy, *(kinds.count(k) / n for k in range(4)),
        sum(v for (a, b), v in changes.items() if a != b) / n, (changes[0, 2] + changes[2, 0] + changes[1, 2] + changes[2, 1]) / n, (changes[0, 1] + changes[1, 0]) / n,
        max((len(m[0]) for m in re.finditer(r"(.)\1*", own, re.S)), default=0) / n, vowels / max(1, letters), known / max(1, letters),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", own))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", own))),
        own.count("/") + own.count("."), float("/" in glued or "\\" in glued), float("://" in glued), float("@" in own or "$" in own[:1] or "{" in own[:2]),
        float(any(w in TRIGGERS for w in left)), float(left[-1:] != [] and left[-1] in TRIGGERS), float(any(w in HARMLESS for w in left)), float(any(w in HARMLESS for w in right)),
        float(before.rstrip()[-1:] in ("=", ":") or before[-2:-1] in ("=", ":", " ") and before[-1:] in ("'", '"')), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(kind == "random"), float(kind in SURE), float(kind == "prefixed"),
        float(bool(re.search(r"example|sample|dummy|placeholder|change_?me|your[-_ ]|x{4,}|\*{4,}|<[a-z]|todo|redacted", own.lower()))),
    ]


def labelled_findings(n: int = 3000, seed: int = 5, between: list[str] | None = None, words: frozenset[str] = frozenset()) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): half secrets, half what only looks like one, planted between words of snippets of documents.

    Without snippets the words are made up; so are those that harmless names are put together from, without a dictionary.
    """
    rng = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    known = sorted(words)
    word = lambda: rng.choice(known) if known and rng.random() < 0.7 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pieces = [p for p in (s.split(" ") for s in between or []) if len(p) > 12 and not any(candidates(w) for w in p)]

    def prose() -> str:
        k = rng.randint(2, 9)
        if not pieces:
            return " ".join(word() for _ in range(k))
        own = rng.choice(pieces)
        at = rng.randrange(len(own) - k)
        return " ".join(own[at : at + k])

    tail = lambda: rng.choice(["", "###", "$$$", "***", "%%%", ".", ",", "\n", ")"])
    out = []
    while len(out) < n:
        label = len(out) % 2
        if label:
            value = rng.choice([lambda: draw(hexes, rng.choice([16, 18, 20, 24, 32, 40, 48, 64])), lambda: draw(alnum, rng.randint(16, 64)), lambda: draw(alnum + "+/", 40) + "=", lambda: "ghp_" + draw(alnum, 36), lambda: "sk-" + draw(alnum, rng.choice([24, 48])), lambda: "AKIA" + draw(alnum[:26] + alnum[-10:], 16), lambda: draw(alnum + "!%^*", rng.randint(10, 18)), lambda: "eyJ" + draw(alnum, 20) + ".eyJ" + draw(alnum, 40) + "." + draw(alnum, 43)])()
            name = rng.choice(["token", "secret", "api_key", "apiKey", "password", "access_token", "client_secret", "SECRET_KEY", "auth_token", "passwd"])
            context = rng.choice(['{n} = "{v}"', "{n}={v}", "{n}: {v}", "'{n}': '{v}'", 'export {n}="{v}"', "Authorization: Bearer {v}"])
        else:
            value, name, context = rng.choice([
                lambda: (draw(hexes, 40), rng.choice(["commit", "revision", "sha1", "blob"]), rng.choice(["{n} {v}", "{n}: {v}"])),
                lambda: (draw(hexes, rng.choice([32, 64])), rng.choice(["md5", "sha256", "checksum", "digest", "etag"]), rng.choice(["{n} = {v}", "{n}: {v}", "{n} {v}"])),
                lambda: ("-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), rng.choice(["id", "uuid", "request"]), "{n}={v}"),
                lambda: (rng.choice(["your_token_here", "xxxxxxxxxxxxxxxx", "changeme123", "example-secret-value", "<your-api-key>", "${SECRET_KEY}", "{{password}}", "********", "process.env.TOKEN", "placeholder_value", "test_password_1", "os.environ"]), rng.choice(["token", "password", "api_key", "secret"]), rng.choice(['{n} = "{v}"', "{n}: {v}"])),
                lambda: ("".join(word() for _ in range(rng.randint(3, 8))) + rng.choice(["", str(rng.randint(1, 99))]), rng.choice([word(), "token", "key", "password"]), rng.choice(["{n} {v}", "{n}: {v}", "{n} = {v}"])),
                lambda: ("/".join(word() for _ in range(rng.randint(3, 6))) + f"/{word()}{rng.randint(1, 9999)}", word(), rng.choice(["{n} https://www.{n}.com/{v}", "/usr/lib/{v}", "{n} {v}"])),
                lambda: ("_".join(word() for _ in range(rng.randint(3, 6))) + f"_{rng.randint(1, 99)}", word(), "{n} {v}"),
                lambda: (draw("0123456789", rng.randint(8, 30)) + draw("-abc", 2), word(), "{n} {v}"),
            ])()
        body = context.format(n=name, v=value)
        text = f"{prose()} {body}{tail()} {prose()}"
        at = text.index(body)
        start = text.rindex(value, at, at + len(body))
        kind = next((k for s, e, k in candidates(text) if s < start + len(value) and start < e), None)
        if kind is None:
            kind = "random"
        out.append((text, start, start + len(value), kind, label))
    return out


class Forest:
    """A random forest of binary splits; every tree sees a bootstrap of the rows and some features at each split."""

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 7):
        self.trees, self.depth, self.seed, self.nodes, self.words = trees, depth, seed, [], frozenset()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            pick, tree = rng.integers(0, len(y), len(y)), []
            self._grow(tree, x[pick], y[pick], 0, rng)
            self.nodes.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
        return self

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        at = len(tree)
        tree.append((-1, 0.0, 0, 0, (y.sum() + 0.5) / (len(y) + 1)))
        if depth == self.depth or len(y) < 4 or y.min() == y.max():
            return at
        best = (np.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False).tolist():
            for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))).tolist():
                left = x[:, f] <= t
                n = left.sum()
                if 0 < n < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    best = min(best, (n * p * (1 - p) + (len(y) - n) * q * (1 - q), f, t))
        if best[0] == np.inf:
            return at
        left = x[:, best[1]] <= best[2]
        a = self._grow(tree, x[left], y[left], depth + 1, rng)
        b = self._grow(tree, x[~left], y[~left], depth + 1, rng)
        tree[at] = (best[1], best[2], a, b, tree[at][4])
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, a, b, p in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at], a[at], b[at]), at)
            out += p[at]
        return out / max(1, len(self.nodes))


def train(findings: list[tuple[str, int, int, str, int]] | None = None, seed: int = 7, words: frozenset[str] = frozenset(), between: list[str] | None = None) -> Forest:
    """A forest from labelled findings (a list, so bounded by the driver's memory); see labelled_findings. It keeps the dictionary."""
    rows = labelled_findings(between=between, words=words) if findings is None else findings
    forest = Forest(seed=seed).fit(np.array([features(*r[:4], words) for r in rows]), np.array([r[4] for r in rows], np.float64))
    forest.words = words
    return forest


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest with the dictionary of the documents, its findings planted into snippets of them."""
    return train(words=dictionary(docs, text_col), between=snippets(docs, id_col, text_col))


def _may_hold(texts: pa.Array) -> list[int]:
    """The rows in which any pattern matches, found without Python."""
    return np.flatnonzero(pc.match_substring_regex(texts, "|".join(p.replace("(?i)", "(?i:", 1) + ")" if p.startswith("(?i)") else p for p in PATTERNS.values())).to_numpy(zero_copy_only=False)).tolist()


def judged(text: str, forest: Forest, threshold: float = 0.5) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, score, is_secret) of all candidates of a text, all of which are scored.

    A secret is a candidate of at least the threshold that doesn't lie within or overlap a longer secret, or as long a one of
    higher score or earlier.
    """
    found = candidates(text)
    if not found:
        return []
    scores = [float(s) for s in forest.score(np.array([features(text, *c, forest.words) for c in found]))]
    starts: list[int] = []
    ends: list[int] = []
    secret = [False] * len(found)
    for i in sorted((i for i, s in enumerate(scores) if s >= threshold), key=lambda i: (found[i][0] - found[i][1], -scores[i], found[i][0])):
        s, e, _ = found[i]
        at = bisect_left(starts, e)
        if not at or ends[at - 1] <= s:
            starts.insert(at, s)
            ends.insert(at, e)
            secret[i] = True
    return [(*c, s, x) for c, s, x in zip(found, scores, secret, strict=True)]


def _findings(texts: pa.Array, forest: Forest, threshold: float) -> Iterator[tuple[int, str, list[tuple[int, int, str, float, bool]]]]:
    """(row, text, judged candidates) of the rows with a candidate."""
    for i in _may_hold(texts):
        text = texts[i].as_py()
        if own := judged(text, forest, threshold):
            yield i, text, own


def hidden(text: str, found: list[tuple[int, int, str, float, bool]], threshold: float, mark: str) -> str:
    """The text with every candidate of at least the threshold replaced, overlapping ones as one."""
    gone = merged([(s, e) for s, e, _, score, _ in found if score >= threshold])
    ends = [0, *(e for _, e in gone)]
    return mark.join(text[a:b] for a, b in zip(ends, [*(s for s, _ in gone), len(text)], strict=True))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, finding, score, is_secret), one row a candidate: offsets in code points, whole texts.

    Candidates may overlap; secrets don't, see judged. A null or empty text has none; repeated rows give repeated findings; a null id is kept. Other columns are not read.
    """

    def work(c: dict) -> dict:
        rows = [(i, *f[:3], text[f[0] : f[1]], *f[3:]) for i, text, found in _findings(c["text"].fill_null(""), forest, threshold) for f in found]
        out = {n: [r[k] for r in rows] for k, n in enumerate(("i", "start", "end", "kind", "finding", "score", "is_secret"))}
        return {
            "doc_id": c["doc_id"].take(pa.array(out["i"], pa.int64())), "start": pa.array(out["start"], pa.int32()), "end": pa.array(out["end"], pa.int32()), "kind": pa.array(out["kind"], pa.string()),
            "finding": pa.array(out["finding"], pa.string()), "score": pa.array(out["score"], pa.float64()), "is_secret": pa.array(out["is_secret"], pa.bool_()),
        }

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, start int, end int, kind string, finding string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", size_col: str = "n_chars", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs, all rows and columns, with every secret replaced by `mark`; size_col, where there is one, is the new length of changed texts.

    Null texts stay null, empty and other texts without secrets as they are; repeated rows change alike; ids aren't read. An empty
    table stays empty.
    """
    names = docs.columns
    at, sized = names.index(text_col), names.index(size_col) if size_col in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            new: dict[int, str] = {}
            for i, text, found in _findings(batch.column(at).fill_null(""), forest, threshold):
                if any(f[4] for f in found):
                    new[i] = hidden(text, found, threshold, mark)
            if new:
                columns = list(batch.columns)
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(list(new.values()), columns[at].type))
                if sized is not None:
                    columns[sized] = pc.replace_with_mask(columns[sized], pa.array(mask), pa.array([len(t) for t in new.values()], columns[sized].type))
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return docs.mapInArrow(released(run), docs.schema)


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs, trained(docs))
