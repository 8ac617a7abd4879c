"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hueweave.llm import mixing, pieces, quality, queries, secret_scan, simhash

TABLES = "documents embeddings pages labels".split()


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*cols).collect()) == key(want.project(", ".join(cols)).fetchall())


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    ids = sorted(rows)
    good = [i for i, s in zip(ids, model.score([rows[i].text for i in ids])) if s >= 0.7]
    left = {r.doc_id for r in simhash.dedup(docs.where(docs.doc_id.isin(good))).collect()}
    forest, texts = secret_scan.trained(docs.where(docs.doc_id.isin(left))), {}
    for i in left:
        text = rows[i].text
        marked = [False] * len(text)
        for s, e, _, score, _ in secret_scan.judged(text, forest):
            if score >= 0.5:
                marked[s:e] = [True] * (e - s)
        # each run of marked characters becomes one mark, adjacent secrets one each
        spans = secret_scan.merged(sorted((s, e) for s, e, _, x, _ in secret_scan.judged(text, forest) if x >= 0.5))
        assert sum(marked) == sum(e - s for s, e in spans)
        for s, e in reversed(spans):
            text = text[:s] + "[SECRET]" + text[e:]
        texts[i] = text
    frame = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, len(t)) for i, t in texts.items()], docs.schema)
    want = {r.doc_id for r in mixing.mix(frame).collect()}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert all(r.text == texts[r.doc_id] and list(r.ids) == library.encode(r.text) and r.decoded == r.text for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """documents with nulls, repeats, empty and long texts, and labels; and the same, empty."""
    good = "the river runs past the old mill and the people of the town walk along it every evening in summer "
    rows = [(i, good * (1 + i % 5) + f"number {i} tells its own story of day {i * 7}", "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [rows[3], rows[3], (3, "another text of the same id, long enough to hold shingles of its own, is kept", "en", None, 5), (None, good, None, "src1", 9), (None, None, "en", "src1", None), (200, None, "en", "src1", 0), (201, "", "en", "src1", 0), (202, "x", None, None, 1)]
    rows += [(203, "aa bb cc dd ee " * 40_000, "en", "src2", 1), (204, "y" * 100_000, "en", "src2", 1), (205, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + good * 2, "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 50), 0) for i in range(60)] + [(200, 0, 0), (203, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    path = str(tmp_path_factory.mktemp("odd"))
    for name, d, keep in (("full", docs, 1000), ("none", docs, 0)):
        d.limit(keep).write.parquet(f"{path}/{name}/documents.parquet")
        labels.limit(keep).write.parquet(f"{path}/{name}/labels.parquet")
    return path, rows


def test_pipeline_odd(spark, odd_folder):
    """Nulls, repeats, empty and long texts: every stage keeps rows whole, the last returns pieces that decode; empty stays empty."""
    path, rows = odd_folder
    got = corpus_pipeline.run(spark, f"{path}/full").collect()
    held = {}
    for i, t, *_ in rows:
        held.setdefault(i, set()).add(t or "")
    assert got and all(r.doc_id in held for r in got)
    assert all((r.text or "") in held[r.doc_id] or "[SECRET]" in r.text for r in got) and all(len(r.ids) == r.n_tokens for r in got)
    assert len(got) == len({(r.doc_id, r.text) for r in got}) + sum(r.doc_id is None for r in got) - len({(r.doc_id, r.text) for r in got if r.doc_id is None})
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stage_with_clashing_columns(spark, odd_folder, at):
    """Further columns, named as stages name their own, come out as they went in."""
    from pyspark.sql import functions as F

    path, _ = odd_folder
    docs = spark.read.parquet(f"{path}/full/documents.parquet")
    names = ["id", "node", "root", "row", "kept", "p", "topic", "tokens", "h", "key", "score", "__gone", "__node", "__own", "finding"]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("source"), F.lit("none"))))
    out = corpus_pipeline.STAGES[at][1](spark, docs, f"{path}/full")
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and rows
    assert all(getattr(r, "key") == f"key of {r.source or 'none'}" and r["__gone"] == f"__gone of {r.source or 'none'}" and r.row == f"row of {r.source or 'none'}" for r in rows)


def test_several_texts_of_an_id(spark):
    """Texts of one id that are no copies stay, whatever the order of rows; their links to other ids count."""
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    rows = [(9, " ".join(base)), (9, " ".join(other)), (15, " ".join(other[:-1])), (4, " ".join(base[:-1])), (20, "alone in the world of five words")]
    want = {(4, rows[3][1]), (9, rows[1][1]), (20, rows[4][1])}
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {tuple(r) for r in simhash.dedup(df).collect()} == want
