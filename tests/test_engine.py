"""Columns, k-mers, colours, simplitigs, archives and files against brute force and fixed examples."""

import os
import random
from urllib.parse import unquote

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hueweave.__main__ import main
from hueweave.functions import bases as B
from hueweave.operators import colors, running, stats
from hueweave.operators.kmers import canonical_strings, codes_of, kmer_files, occurrences, window_strings
from hueweave.operators.simplitigs import glue, simplitigs
from hueweave.plans import queries
from hueweave.plans.pipeline import archive_stats, compress
from hueweave.sources import codec
from hueweave.sources.archive import Archive, decompress, missing_files, within, write_archive
from hueweave.sources.fasta import check_extensions, files_table, read_fasta, read_name_map
from hueweave.streaming.incremental import latest, latest_sets, stream_colors

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def canon(s):
    return min(s, rc(s))


def dna(rng, n, chars="ACGT"):
    return "".join(rng.choice(chars) for _ in range(n))


def effective(s, k):
    bad = sum(c not in "ACGT" for c in s[:k])
    return "A" * bad + "".join(c for c in s if c in "ACGT")


def kmers_of(s, k):
    e = effective(s, k)
    return [canon(e[i : i + k]) for i in range(len(e) - k + 1)] if len(s) >= k else []


def one(spark, *cols, **values):
    return tuple(spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*cols).first())


def test_fixed_examples(spark):
    rows = {"ATCG": "CGAT", "CATAATCCAGC": "GCTGGATTATG", "AGCTTTTCATTCTGACTGCAACGGGCAATAT": "ATATTGCCCGTTGCAGTCAGAATGAAAAGCT"}
    for s, want in rows.items():
        assert one(spark, B.revcomp("s"), B.canonical("s"), s=s) == (want, min(s, want))
    assert B.pack_one("ACG") == b"\x24" and B.pack_one("AAC") == b"\x10" and B.pack_one("CGA") == b"\x09"


def test_codes(spark):
    rng = random.Random(1)
    for k in (1, 3, 15, 31):
        words = [dna(rng, k) for _ in range(200)] + ["T" * k, "A" * k]
        df = spark.createDataFrame([(w, "ACGT"[i % 4], i % 4) for i, w in enumerate(words)], "w string, b string, c int").withColumn("x", B.kmer_encode("w"))
        got = df.select("w", "b", B.kmer_decode("x", k).alias("back"), B.kmer_decode(B.revcomp_code("x", k), k).alias("rc"), B.kmer_decode(B.canonical_code("x", k), k).alias("canon"), B.kmer_decode(B.append_code("x", "c", k), k).alias("app"), B.kmer_decode(B.prepend_code("x", "c", k), k).alias("pre"), (B.revcomp_code(B.revcomp_code("x", k), k) == F.col("x")).alias("twice"), B.append("w", "b").alias("sa"), B.prepend("w", "b").alias("sp"), B.successors("w").alias("succ"), B.predecessors("w").alias("pred"), B.is_canonical("w").alias("isc")).collect()
        for r in got:
            assert (r.back, r.rc, r.canon, r.app, r.pre, r.twice) == (r.w, rc(r.w), canon(r.w), r.w[1:] + r.b, r.b + r.w[:-1], True)
            assert (r.sa, r.sp, r.isc) == (r.app, r.pre, r.w < rc(r.w)) and list(r.succ) == [r.w[1:] + b for b in "ACGT"] and list(r.pred) == [b + r.w[:-1] for b in "ACGT"]
    with pytest.raises(ValueError):
        B.check_k(33)
    with pytest.raises(ValueError):
        B.check_k(4)


def test_bases_and_colors(spark):
    assert one(spark, *(B.base_encode(F.lit(c)) for c in "ACGTNa")) == (0, 1, 2, 3, None, None)
    assert one(spark, *(B.base_decode(F.lit(i)) for i in (0, 1, 2, 3, 6))) == ("A", "C", "G", "T", "G")
    df = spark.createDataFrame([(m,) for m in (0, 1, 5, 2**20 - 1, 2**62)], "m long")
    for r in df.select("m", B.color_string("m", 63).alias("t"), B.color_files("m", 63).alias("f"), B.popcount("m").alias("p")).withColumn("back", B.color_mask("t")).withColumn("pt", B.popcount_text("t")).withColumn("pad", B.padded_color("t")).collect():
        assert r.t == bin(r.m)[2:][::-1].ljust(63, "0") and r.back == r.m and list(r.f) == [i for i in range(63) if r.m >> i & 1] and r.p == r.pt == len(r.f) and r.pad == r.t + "0"
    names = {"/a/x.fa.zst": ("x.fa.zst", "x.fa", "x"), "y": ("y", "y", "y"), "/b.c/.hid": (".hid", ".hid", ""), "q.": ("q.", "q", "q")}
    for p, want in names.items():
        assert one(spark, B.basename("p"), B.file_stem("p"), B.short_name("p"), p=p) == want


def test_minimizer_and_pack(spark):
    rng = random.Random(2)
    words = [dna(rng, 31) for _ in range(100)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", B.minimizer("w").alias("m"), B.kmer_decode(B.minimizer_code(B.kmer_encode("w"), 31), 7).alias("c")).collect():
        own = [r.w[i : i + 7] for i in range(25)]
        assert r.m == min(own) and r.c == min(map(canon, own))
    seqs = [dna(rng, n) for n in range(0, 40)]
    df = spark.createDataFrame([(s, len(s)) for s in seqs] + [(None, None)], "s string, n int").withColumn("p", B.pack("s"))
    for r in df.select("s", "p", B.unpack("p", "n").alias("back"), B.packed_size("n").alias("size")).collect():
        assert r.back == r.s and (r.s is None or r.size == len(r.p) == -(-len(r.s) // 4))
    with pytest.raises(ValueError):
        B.pack_one("ACN")


@pytest.mark.parametrize("k", [3, 5, 31])
def test_windows(spark, k):
    rng = random.Random(k)
    seqs = [dna(rng, rng.randint(0, 700), "ACGTNa" if i % 2 else "ACGT") for i in range(60)] + ["AC"]
    rows = spark.createDataFrame([(i, i % 7, s) for i, s in enumerate(seqs)], "doc long, file_id int, seq string")
    got = {}
    for r in canonical_strings(rows, k).collect():
        got.setdefault(r.doc, []).append(r.kmer)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(kmers_of(s, k)) for i, s in enumerate(seqs) if len(s) >= k}
    strict = {i: sorted(canon(s[j : j + k]) for j in range(len(s) - k + 1) if set(s[j : j + k]) <= set("ACGT")) for i, s in enumerate(seqs)}
    got = {}
    for r in canonical_strings(rows, k, invalid="break").collect():
        got.setdefault(r.doc, []).append(r.kmer)
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in strict.items() if v}
    n = {r.file_id: r.n_windows for r in occurrences(rows, k).collect()}
    assert n == {f: t for f in range(7) if (t := sum(len(kmers_of(s, k)) for i, s in enumerate(seqs) if i % 7 == f))}
    with pytest.raises(Exception, match="shorter"):
        window_strings(rows, k, on_short="error").count()


@pytest.mark.parametrize("n_files", [1, 5, 70])
def test_colors(spark, n_files):
    rng, k = random.Random(n_files), 5
    base = dna(rng, 40)
    seqs = [(i, base + dna(rng, 60)) for i in range(n_files)] + [(0, "ACNGTTTACG"), (0, "AC")]
    rows = spark.createDataFrame(seqs, "file_id int, seq string").repartition(3)
    want = {}
    for f, s in seqs:
        for x in kmers_of(s, k):
            want.setdefault(x, set()).add(f)
    got, sets = colors.color_sets(rows, n_files, k)
    listed = {r.color: list(r.file_ids) for r in sets.collect()}
    assert all(listed[r.color] == [i for i in range(n_files) if r.color >> i & 1] for r in got.collect()) if n_files <= 63 else True
    named = {r.s: (r.color if n_files <= 63 else listed[r.color], r.popcount) for r in got.withColumn("s", B.kmer_decode("kmer", k)).collect()}
    assert named == {x: (sum(1 << f for f in v) if n_files <= 63 else sorted(v), len(v)) for x, v in want.items()}
    assert colors.omni(got, n_files).count() == sum(len(v) == n_files for v in want.values())
    assert colors.multi(got, n_files).count() == sum(len(v) < n_files for v in want.values())
    assert {r["class"]: r.n_kmers for r in colors.distinct_totals(got, n_files).collect()}.get("omni", 0) == sum(len(v) == n_files for v in want.values())
    if 1 < n_files <= 63:
        churn = {r.file_id: (r.n_before, r.n_removed) for r in colors.churn(got, n_files).collect()}
        for f in range(1, n_files):
            held = [v for v in want.values() if set(range(f)) <= v]
            assert churn[f] == (len(held), sum(f not in v for v in held))
        edges = {(r.kmer, r.neighbour, r.side, r.base) for r in colors.neighbours(got.select("kmer"), k).collect()}
        code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
        brute = {(code(x), code(canon(y)), side, b) for x in want for b in range(4) for side, y in (("right", x[1:] + "ACGT"[b]), ("left", "ACGT"[b] + x[:-1])) if canon(y) in want}
        assert edges == brute
        half = [colors.color_kmers(rows.where(f"file_id % 2 = {i}"), n_files, k) for i in (0, 1)]
        assert colors.merge_colors(*half).exceptAll(got.select("kmer", "color", "popcount")).count() == 0


def test_long_sequences_in_pieces(monkeypatch, spark):
    import hueweave.operators.kmers as K

    s = dna(random.Random(9), 5000)
    want = sorted(set(kmers_of(s, 31)))
    monkeypatch.setattr(K, "PIECE", 100)
    assert sorted({x for p in K._pieces(s, 31) for x in codes_of(p, 31).tolist()}) == sorted(int(x.translate(str.maketrans("ACGT", "0123")), 4) for x in want)
    assert kmer_files(spark.createDataFrame([(0, s)], "file_id int, seq string"), 31).count() == len(want)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_simplitigs(spark, most):
    rng, k = random.Random(3), 5
    seqs = [(i % 4, dna(rng, 80)) for i in range(12)] + [(0, "A" * 20), (1, "ACGTACGTACGT")]
    got = colors.color_kmers(spark.createDataFrame(seqs, "file_id int, seq string"), 4, k)
    out = simplitigs(got.select("kmer", "color"), k, most=most).collect()
    windows = [(r.color, canon(r.seq[i : i + k])) for r in out for i in range(len(r.seq) - k + 1)]
    want = [(r.color, r.s) for r in got.withColumn("s", B.kmer_decode("kmer", k)).collect()]
    assert sorted(windows) == sorted(want) and all(r.len == len(r.seq) for r in out)
    again = simplitigs(got.select("kmer", "color").repartition(7), k, most=most).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert {r.color: r.n_kmers for r in stats.kmers_per_color(spark.createDataFrame(out), k).collect()} == {r.color: r.n_kmers for r in colors.per_color(got).collect()}


def test_glue_is_maximal():
    """Each k-mer once, and no end of a string can be joined to an end of another, rings and runs of one base included."""
    rng = random.Random(5)
    for i in range(1500):
        k = rng.choice([1, 3, 3, 5, 7])
        words = {x for _ in range(rng.randint(1, 4)) for x in codes_of(dna(rng, rng.randint(k, 60), "ACGT"[: rng.choice([1, 2, 3, 4])]), k).tolist()}
        words = sorted(x for x in words if i % 3 or rng.random() < 0.7)
        out = glue(words, k)
        assert sorted(x for s in out for x in codes_of(s, k).tolist()) == words
        # an end is the (k-1)-mer by which a walk leaves the string
        ends = [(n, e) for n, s in enumerate(out) for e in (s[len(s) - k + 1 :], rc(s[: k - 1]))]
        assert not any(a != b and x == rc(y) for a, x in ends for b, y in ends)


def test_directory(spark):
    rows = spark.createDataFrame([(2, 5, "ACGTA"), (1, 3, "ACG"), (2, 4, "ACGT")], "color long, len int, seq string")
    got = [tuple(r) for r in stats.color_directory(rows, lens=True).orderBy("color").collect()]
    assert got == [(1, 1, 3, 1, 0, 1, [3]), (2, 2, 9, 3, 1, 4, [4, 5])]
    assert stats.color_directory(rows.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, parts):
    """Sums and followers over ranges are those of one sorted list, whatever the number of ranges."""
    rng = random.Random(parts)
    keys = rng.sample(range(-500, 500), 300)
    df = spark.createDataFrame([(k, k % 11) for k in keys], "k long, v long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        sums = {r.k: r.s for r in running.running_sum(df, ["k"], F.col("v"), "s").collect()}
        after = {r.k: r.x for r in running.following(df, "k", "x").collect()}
        assert running.following(df.limit(0), "k", "x").count() == 0
        assert running.following(df.where("k = 1").union(spark.sql("select 1L, 1L")).limit(1), "k", "x").first().x == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys.sort()
    assert sums == {k: sum(x % 11 for x in keys[: i + 1]) for i, k in enumerate(keys)}
    assert after == dict(zip(keys, keys[1:] + keys[:1]))


def fasta(path, seqs, width=60, end="\n"):
    text = "".join(f">r{i} a>b{end}" + "".join(s[j : j + width] + end for j in range(0, len(s), width)) for i, s in enumerate(seqs))
    raw = text.encode()
    path.write_bytes(zstandard.ZstdCompressor().compress(raw) if path.suffix == ".zst" else raw)
    return str(path)


def test_files_to_archive_and_back(spark, tmp_path):
    rng = random.Random(6)
    base = dna(rng, 200)
    seqs = {"x.fa": [base, dna(rng, 150)], "y.fasta": [dna(rng, 90) + base], "z.fa.zst": [base[:120], dna(rng, 40), "ACG"], "x.fna": [dna(rng, 100)]}
    paths = [fasta(tmp_path / n, s, end="\r\n" if n == "y.fasta" else "\n") for n, s in seqs.items()]
    read = read_fasta(files_table(spark, paths))
    assert sorted((r.file_id, r.seq) for r in read.collect()) == sorted((i, s) for i, v in enumerate(seqs.values()) for s in v)
    with pytest.raises(ValueError):
        check_extensions(["a.gz"])
    fof = tmp_path / "fof.txt"
    fof.write_text("\n".join(paths) + "\n")
    k = 15
    main(["compress", str(fof), str(tmp_path / "ar"), "-k", str(k)], spark)
    archive = Archive(spark, str(tmp_path / "ar"))
    want = {p: {x for s in v for x in kmers_of(s, k)} for p, v in zip(paths, seqs.values())}
    sets = lambda df: {p: {canon(s[i : i + k]) for r in df.where(F.col("file") == p).collect() for s in [r.seq] for i in range(len(s) - k + 1)} for p in {r.file for r in df.collect()}}
    assert sets(decompress(archive)) == want
    asked = [paths[3], paths[1]]
    assert sets(decompress(archive, asked)) == {p: want[p] for p in asked}
    with pytest.raises(ValueError, match="nowhere"):
        decompress(archive, ["nowhere", paths[0]])
    assert set(sets(decompress(archive, ["nowhere", paths[0]], on_missing="skip"))) == {paths[0]}
    assert [r.path for r in missing_files(archive.files, ["nowhere", paths[0]]).collect()] == ["nowhere"]
    full = [r for r in archive.colors.collect() if len(r.file_ids) == 4]
    assert all(r.color_id == 0 for r in full) and archive.colors.where("color_id = 0").count() == len(full)
    per_color, per_len, per_pop = archive_stats(archive)
    held = {}
    for p, v in want.items():
        for x in v:
            held.setdefault(x, set()).add(p)
    pops = {}
    for v in held.values():
        pops[len(v)] = pops.get(len(v), 0) + 1
    assert {r.popcount: r.n_kmers for r in per_pop.collect()} == pops and sum(r.n_kmers for r in per_color.collect()) == len(held)
    assert sum(r.n_simplitigs for r in per_len.collect()) == archive.simplitigs.count()
    wanted = tmp_path / "wanted.txt"
    wanted.write_text(paths[2] + "\n")
    main(["decompress", str(tmp_path / "ar"), str(tmp_path / "dump"), "-Q", str(wanted)], spark)
    text = "".join(p.read_text() for p in (tmp_path / "dump" / "dump=Dump_z.fa").glob("part-*"))
    assert {canon(s[i : i + k]) for s in text.replace(">\n", "").split("\n") for i in range(len(s) - k + 1)} == want[paths[2]]
    main(["stats", str(tmp_path / "ar"), str(tmp_path / "st")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "st" / "kmer_per_popcount")).count() == len(pops)
    codec.write_binary(str(tmp_path / "bin"), archive.files, archive.colored(), 4)
    back = codec.read_binary(spark, str(tmp_path / "bin"))
    rows = archive.colored().select("text", "len", "seq")
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()
    some = codec.read_binary(spark, str(tmp_path / "bin"), [1])
    assert some.exceptAll(rows.where("substr(text, 2, 1) = '1'")).count() == 0 and some.count() == rows.where("substr(text, 2, 1) = '1'").count()
    assert sorted(p.name for p in (tmp_path / "ar").iterdir()) == ["colors", "files", "meta", "simplitigs"]
    assert sorted(map(tuple, read_name_map(spark, str(tmp_path / "bin" / codec.NAMES)).collect())) == list(enumerate(paths))
    archive.views("a_")
    assert spark.sql("select count(*) from a_simplitigs join a_colors using (color_id)").first()[0] == archive.simplitigs.count()


def test_worked_example(spark, tmp_path):
    """K = 3, ACGTT and ACGA: one k-mer in both, one in either."""
    files = files_table(spark, ["f0.fa", "f1.fa"])
    rows = spark.createDataFrame([(0, "ACGTT"), (1, "ACGA")], "file_id int, seq string")
    archive = compress(files, str(tmp_path / "ar"), 3, rows)
    assert sorted((r.text, r.seq) for r in archive.simplitigs.join(archive.colors, "color_id").collect()) == [("01", "CGA"), ("10", "AAC"), ("11", "ACG")]
    codec.write_binary(str(tmp_path / "b"), files, archive.colored(), 2)
    assert (tmp_path / "b" / codec.OMNI).read_bytes() == b"\x03\x00\x00\x00\x24"
    lines = zstandard.ZstdDecompressor().stream_reader((tmp_path / "b" / codec.DIRECTORY).read_bytes()).read().decode()
    assert lines == "10000000,1:3\n01000000,2:3\n" and codec.parse_directory(lines) == [("10000000", 1, [3]), ("01000000", 2, [3])]


def test_wide_archive(spark, tmp_path):
    n, rng = 70, random.Random(7)
    base = dna(rng, 60)
    rows = spark.createDataFrame([(i, base + dna(rng, 30)) for i in range(n)], "file_id int, seq string")
    archive = compress(files_table(spark, [f"f{i}.fa" for i in range(n)]), str(tmp_path / "ar"), 15, rows)
    top = archive.colors.where("color_id = 0").first()
    assert list(top.file_ids) == list(range(n)) and top.text == "1" * n
    got = {r.file_id for r in decompress(archive, ["f69.fa"]).collect()}
    assert got == {69}
    codec.write_binary(str(tmp_path / "b"), archive.files, archive.colored(), n)
    back, want = codec.read_binary(spark, str(tmp_path / "b")), archive.colored().select("text", "len", "seq")
    assert back.exceptAll(want).count() == 0 and back.count() == want.count()


@pytest.mark.parametrize("n", [70, 1024])
def test_wide_sets(spark, n):
    """Churn and merging beyond 63 files, against sets."""
    rng, k = random.Random(n), 7
    base = dna(rng, 50)
    seqs = [(i, base[: rng.randint(10, 50)] + dna(rng, 12)) for i in range(n)]
    kmers, sets = colors.color_sets(spark.createDataFrame(seqs, "file_id int, seq string").repartition(5), n, k)
    want = {}
    for f, s in seqs:
        for x in kmers_of(s, k):
            want.setdefault(x, set()).add(f)
    firsts = [min(set(range(n + 1)) - v) for v in want.values()]
    got = {r.file_id: (r.n_before, r.n_removed) for r in colors.churn(kmers, n, sets).collect()}
    assert got == {f: (sum(x >= f for x in firsts), sum(x == f for x in firsts)) for f in range(1, n)}
    part = lambda rows: colors.color_sets(spark.createDataFrame(rows, "file_id int, seq string"), n, k)
    merged, both = colors.merge_sets(part(seqs[: n // 2]), part(seqs[n // 3 :]))
    named = lambda a, b: sorted((r.kmer, r.popcount, r.file_ids) for r in a.join(b, "color").collect())
    assert named(merged, both) == named(kmers, sets)
    assert {r.kmer: r.color for r in merged.collect()} == {r.kmer: r.color for r in kmers.collect()}


def test_stream(spark, tmp_path):
    src, rng = tmp_path / "in", random.Random(8)
    seqs = [(i, dna(rng, 60)) for i in range(4)]
    for i, s in seqs:
        spark.createDataFrame([(i, s)], "file_id int, seq string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("file_id int, seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    stream_colors(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 5).trigger(availableNow=True).start().awaitTermination()
    want = colors.color_kmers(spark.createDataFrame(seqs, "file_id int, seq string"), 4, 5)
    got = latest(spark, str(tmp_path / "out"))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    stream_colors(stream, str(tmp_path / "wide"), str(tmp_path / "cp2"), 5, n_files=70).trigger(availableNow=True).start().awaitTermination()
    got = latest(spark, str(tmp_path / "wide")).join(latest_sets(spark, str(tmp_path / "wide")), "color")
    assert sorted((r.kmer, sum(1 << i for i in r.file_ids)) for r in got.collect()) == sorted((r.kmer, r.color) for r in want.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    if name not in queries.SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in got.select(*cols).collect()) == key(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a#1.fa", "p%q.fa", "br[1].fa", "x+y.fa", "a:b.fa", "é è.fa", "{a,b}.fa", "st*r?.fa", "back\\slash.fa", "z%20 #[1]+.fa.zst"])
def test_fasta_names(spark, tmp_path, name):
    """Any name is read back, and no other file with it."""
    for other in ("br1.fa", "a.fa", "b.fa", "star1.fa", "z .fa.zst"):
        fasta(tmp_path / other, ["GGGG"])
    path = fasta(tmp_path / name, ["ACGTAC", "TTTT"])
    assert sorted((r.file_id, r.seq) for r in read_fasta(files_table(spark, [str(tmp_path / "a.fa"), path])).collect()) == [(0, "GGGG"), (1, "ACGTAC"), (1, "TTTT")]


def test_fasta_lost(spark, tmp_path):
    """A file that Spark hides raises, an empty one has no records."""
    hidden, empty = fasta(tmp_path / "_a.fa", ["ACGT"]), tmp_path / "e.fa"
    empty.write_bytes(b"")
    with pytest.raises(Exception, match="_a.fa"):
        read_fasta(files_table(spark, [hidden])).collect()
    assert read_fasta(files_table(spark, [str(empty), fasta(tmp_path / "f.fa", ["ACGT"])])).collect()[0].file_id == 1


def test_targeted_read_prunes(spark, tmp_path):
    """One file's strings: buckets of other colours aren't opened, and the scan is given ranges of ids."""
    rng, n = random.Random(3), 12
    rows = spark.createDataFrame([(i, dna(rng, 4000)) for i in range(n)], "file_id int, seq string")
    files = files_table(spark, [f"f{i}.fa" for i in range(n)])
    kmers, _ = colors.color_sets(rows, n, 15)
    write_archive(str(tmp_path / "ar"), files, simplitigs(kmers.select("kmer", "color"), 15), 15, bucket_bytes=1000)
    archive = Archive(spark, str(tmp_path / "ar"))
    assert archive.colors.select("bucket").distinct().count() >= n - 2
    got = decompress(archive, ["f5.fa"])
    plan = got._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1][:60] and "GreaterThanOrEqual(color_id" in text
    assert {r.file for r in got.collect()} == {"f5.fa"}
    ids = archive.colors.where(F.array_contains("file_ids", 5)).select("bucket", "color_id")
    buckets, ranges = within(ids)
    read = archive.simplitigs.where(F.col("bucket").isin(buckets) & ranges)
    # a scan of the wanted buckets only: read bytes by files
    size = lambda fs: sum(os.path.getsize(unquote(f).replace("file://", "").removeprefix("file:")) for f in fs)
    opened = read.select("seq", "_metadata.file_path").select("file_path").distinct().collect()
    assert size([r.file_path for r in opened]) < size(archive.simplitigs.inputFiles()) / 3
    assert read.count() <= 2 * archive.simplitigs.join(ids, "color_id", "left_semi").count()


def test_ranges_hold_all_ids(spark):
    rng = random.Random(9)
    for most in (1, 2, 7, 64):
        ids = sorted(rng.sample(range(1000), 60))
        df = spark.createDataFrame([(i // 100, i) for i in ids], "bucket int, color_id long")
        buckets, ranges = within(df, most)
        got = {r.color_id for r in spark.range(1000).withColumnRenamed("id", "color_id").where(ranges).collect()}
        assert set(ids) <= got and buckets == sorted({i // 100 for i in ids})
        assert most < 64 or got == set(ids)
    assert within(df.where("false"))[0] == []


def test_pushdown(spark, tmp_path):
    """A targeted read prunes columns and joins strings on the clustered key; sequences are read by their columns only."""
    rows = spark.createDataFrame([(0, "ACGTTACG"), (1, "ACGATTTC")], "file_id int, seq string")
    archive = compress(files_table(spark, ["a.fa", "b.fa"]), str(tmp_path / "ar"), 3, rows)
    plan = decompress(archive, ["b.fa"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<color_id" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert np.array_equal(codes_of("ACGTT", 3), codes_of("AACGT", 3)[::-1])


@pytest.mark.parametrize("k", [21, 31])
def test_runs_hold_all_kmers(spark, k):
    """K-mers go packed in runs: the same k-mers and colours as by brute force, the same strings as from single k-mers, and a few bytes each."""
    rng = random.Random(77)
    whole = "".join(rng.choice("ACGT") for _ in range(6000))
    seqs = [(i % 5, whole[rng.randrange(3000) :][: rng.randint(k, 3000)]) for i in range(30)] + [(0, "A" * 200), (1, "ACGT" * 60), (2, "ACGTN" * 30 + whole[:90])]
    rows = spark.createDataFrame(seqs, "file_id int, seq string").repartition(3)
    want = {}
    for f, s in seqs:
        for x in codes_of(s, k).tolist():
            want[x] = want.get(x, 0) | 1 << f
    how = {"invalid": "break"}
    kmers, _ = colors.color_sets(rows, 5, k, **how)
    assert {r.kmer: r.color for r in kmers.collect()} == want and kmers.count() == len(want)
    runs, sets = colors.color_runs(rows, 5, k, **how)
    held = runs.collect()
    assert sum(r.n for r in held) == len(want) and sum(len(r.runs) for r in held) < 4 * len(want)  # a k-mer alone has eight bytes
    assert {r.color for r in sets.collect()} == set(want.values())
    for most in (10**6, 200):
        got = sorted(map(tuple, simplitigs(runs, k, most=most).collect()))
        assert got == sorted(map(tuple, simplitigs(kmers.select("kmer", "color"), k, most=most).collect()))
        assert sorted((x, c) for c, _, s in got for x in codes_of(s, k).tolist()) == sorted(want.items())
    # more files than a mask has bits
    wide = spark.createDataFrame([(f * 30, s) for f, s in seqs], "file_id int, seq string")
    runs, sets = colors.color_runs(wide, 130, k, **how)
    of = {r.color: sum(1 << f // 30 for f in r.file_ids) for r in sets.collect()}
    assert sorted((x, of[r.color]) for r in simplitigs(runs, k).collect() for x in codes_of(r.seq, k).tolist()) == sorted(want.items())


def test_digests_of_windows(spark):
    """MD5 over arrays and sums over windows, against hashlib and strings, for sequences that end a batch's piece or are as long as a window."""
    import hashlib

    from hueweave.operators import digests

    rng = random.Random(5)
    letters = np.frombuffer("".join(rng.choice("ACGT") for _ in range(9000)).encode(), np.uint8)
    head = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    for size in (5, 30, 31, 32):
        got = digests.md5_heads(digests._words(letters, size), size)
        assert len(got) == 9001 - size and all(int(got[i]) == head(letters[i : i + size].tobytes().decode()) for i in (0, 1, 77, 8191, 8192, 9000 - size))
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([31, 32, 33, 400, 31, 90])] + [(3, "ACGT" * 20), (None, "A" * 50)]
    rows = spark.createDataFrame(seqs, "doc_id long, seq string").coalesce(1)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    least = lambda s: min(s[i : i + 7] for i in range(25))
    cut = lambda s, k: [s[i : i + k] for i in range(len(s) - k + 1)]
    want = sorted((str(i), len(w), sum(head(least(x)) for x in w), sum(head(min(least(x), least(rc(x)))) for x in w)) for i, s in seqs if (w := cut(s, 31)))
    assert sorted((str(r[0]), *r[1:]) for r in digests.minimizer_sums(rows, "doc_id", 31).collect()) == want
    want = sorted((str(i), len(w), sum(head(x[1:]) for x in w), sum(head(x[31] + x[:30]) for x in w), sum(head(rc(x[:31])) for x in w)) for i, s in seqs if (w := cut(s, 32)))
    assert sorted((str(r[0]), *r[1:]) for r in digests.slide_sums(rows, "doc_id", 31).collect()) == want
    # neither query makes a row or a string of a window
    for q in ("minimizer", "slide_codes"):
        assert "Generate" not in entry.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
