import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import components, line_dedup, near_dup, queries, window_dedup
from quire.llm._text import shingle_sets
from tests.conftest import SF
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, n=150):
    """Random texts with edited copies of each other, and shared passages."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and out:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randrange(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        else:
            w = words(rng, rng.randrange(1, 140))
        if kind > 0.85:
            w = w[:20] + passage + w[20:]
        out.append(" ".join(w))
    return list(enumerate(out))


def near(d):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d).collect()}


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    assert near(docs(spark, rows)) == brute.near_duplicates(rows)
    assert near(docs(spark, rows).repartition(7, "text")) == brute.near_duplicates(rows)


def test_near_duplicates_on_the_test_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op6_circulant_minhash"](spark, SF).collect()}
    want = brute.near_duplicates(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_buckets_of_several_components_are_compared_across(spark):
    """Members of one bucket that the hub doesn't link are linked with each other, in tiles."""
    rng = random.Random(8)
    base = words(rng, 100, 10**6)
    texts = [(1, " ".join(words(rng, 100, 10**6)))] + [(i, " ".join(base[:97] + [f"own{i}"])) for i in range(2, 600)]
    sets = list(shingle_sets(pa.array([t for _, t in texts])))
    sig = (near_dup.signatures(sets) & 255).astype(np.uint8)
    sig[:, :4] = 7  # all in the bucket of the first band
    m = spark.createDataFrame([(7, 0, i, len(s), i) for (i, _), s in zip(texts, sets, strict=True)], "key long, band int, id long, n long, comp long")
    g = spark.createDataFrame([(i, len(s), bytearray(x.tobytes())) for (i, _), s, x in zip(texts, sets, sig, strict=True)], "id long, n long, sig binary")
    t = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in texts], "id long, t binary")
    links = [tuple(r) for r in near_dup.across(m, g, t).collect()]
    of = brute.components(links, [i for i, _ in texts])
    assert of[1] == 1 and {of[i] for i in range(2, 600)} == {2} and len(links) < 6 * 600


def test_bytes_that_agree_by_chance_hide_no_pair(spark):
    """The low bytes of a band agree, its coordinates don't, and a later band's bucket is the first that the pair shares."""
    rng = random.Random(11)
    for _ in range(20000):
        base = words(rng, 104, 10**6)
        texts = [(1, " ".join(base)), (2, " ".join(base[:88] + words(rng, 12, 10**6)))]
        sets = list(shingle_sets(pa.array([t for _, t in texts])))
        sig = near_dup.signatures(sets)
        keys = near_dup.bands(sig[:, : near_dup.BANDED]).view(np.int64)
        low = (sig & 255).astype(np.uint8)
        shared, looks = np.flatnonzero(keys[0] == keys[1]), (low[0] == low[1])[: near_dup.BANDED].reshape(-1, near_dup.ROWS).all(1)
        if near_dup.similar(*sets) and len(shared) and looks.argmax() < shared[0] and (low[0] == low[1]).sum() >= near_dup.AGREE:
            break
    else:
        raise AssertionError("no such pair")
    m = spark.createDataFrame([(int(keys[0][k]), int(k), i, len(s), i) for k in shared for (i, _), s in zip(texts, sets, strict=True)], "key long, band int, id long, n long, comp long")
    g = spark.createDataFrame([(i, len(s), bytearray(x.tobytes()), k.tolist()) for (i, _), s, x, k in zip(texts, sets, low, keys, strict=True)], "id long, n long, sig binary, keys array<long>")
    t = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in texts], "id long, t binary")
    assert {tuple(sorted(r)) for r in near_dup.across(m, g, t).collect()} == {(1, 2)}


def test_no_pair_that_shares_a_bucket_is_passed_over(spark):
    """Pairs just above 0.75, compared across components only, without a hub that joins them."""
    rng = random.Random(21)
    texts = []
    for k in range(1200):
        base = words(rng, 104, 10**6)
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:89] + words(rng, 11, 10**6)))]
    sets = list(shingle_sets(pa.array([t for _, t in texts])))
    sig = near_dup.signatures(sets)
    keys = near_dup.bands(sig[:, : near_dup.BANDED]).view(np.int64)
    want = {(2 * k, 2 * k + 1) for k in range(1200) if near_dup.similar(sets[2 * k], sets[2 * k + 1]) and (keys[2 * k] == keys[2 * k + 1]).any()}
    m = spark.createDataFrame([(int(keys[i][b]), b, i, len(sets[i]), i) for k in range(1200) for b in np.flatnonzero(keys[2 * k] == keys[2 * k + 1]).tolist() for i in (2 * k, 2 * k + 1)], "key long, band int, id long, n long, comp long")
    g = spark.createDataFrame([(i, len(x), bytearray(b.tobytes()), k.tolist()) for (i, _), x, b, k in zip(texts, sets, (sig & 255).astype(np.uint8), keys, strict=True)], "id long, n long, sig binary, keys array<long>")
    t = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in texts], "id long, t binary")
    assert len(want) > 1100 and {tuple(sorted(r)) for r in near_dup.across(m, g, t).collect()} == want


def test_similar_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.similar(a, a[:75]) and not near_dup.similar(a, a[:74]) and not near_dup.similar(a[:0], a[:0])


def test_minhash_estimates_similarity():
    a, b = shingle_sets(pa.array([" ".join(f"x{i}" for i in range(404)), " ".join(f"x{i}" for i in range(304))]))
    s = near_dup.signatures([a, b], 2048)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.05


@pytest.mark.parametrize("name", ["near", "windows", "lines"])
def test_edge_cases(spark, name):
    long = " ".join(f"v{i}" for i in range(300000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, long), (7, long), (4, "a b"), (None, None), (8, "ü " * 60)]
    d = docs(spark, rows).withColumn("id", F.lit("x")).withColumn("t", F.lit(1)).withColumn("key", F.lit(2)).withColumn("h", F.lit(3))
    empty = d.limit(0)
    if name == "near":
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(d).collect()), key=str)
        assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (None, 0, None, True), (6, 299996, 6, True), (7, 299996, 6, False), (8, 1, 8, True)], key=str)
        assert near_dup.near_duplicates(empty).count() == 0
    elif name == "windows":
        got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in window_dedup.dedup_windows(d).collect()), key=str)
        assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (4, 2, 0), (5, 2, 0), (None, 2, 0), (None, 0, 0), (6, 300000, 0), (7, 300000, 300000), (8, 60, 0)], key=str)
        assert window_dedup.dedup_windows(empty).count() == 0
    else:
        gone = {r.doc_id: r.n for r in line_dedup.dedup_lines(d, n_removed="n", words=line_dedup.PASSAGE).collect()}
        assert gone[7] == 1 and gone[6] == gone[8] == 0  # a long line of an earlier document
        out = line_dedup.dedup_lines(d)
        assert out.columns == d.columns and out.count() == len(rows) and line_dedup.dedup_lines(empty).count() == 0
        assert sorted([r.text for r in out.collect()], key=str) == sorted([t for _, t in rows], key=str)


def test_windows_against_brute_force(spark):
    rows = corpus(5, 120)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.dedup_windows(docs(spark, rows)).collect()}
    assert got == brute.windows(rows) and sum(x[1] for x in got.values()) > 500


def test_windows_of_repeating_texts(spark, monkeypatch):
    """Long runs of one key are cut into several spans."""
    monkeypatch.setattr(window_dedup, "SPAN", 16)
    rows = [(1, "x " * 300), (2, "a b " * 130), (3, "y " + "x " * 200), (4, "b " + "a b " * 100 + "x " * 60), (5, "x " * 300), (6, "x " * 49)]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.dedup_windows(docs(spark, rows)).collect()} == brute.windows(rows)


def test_windows_through_a_full_sketch(spark, monkeypatch):
    """A sketch that says yes to everything loses nothing."""
    monkeypatch.setattr(window_dedup, "sketch", lambda d, bits: b"\xff" * (window_dedup.DEPTH << (bits - 3)))
    rows = corpus(6, 60)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.dedup_windows(docs(spark, rows)).collect()} == brute.windows(rows)


def test_rows_of_one_id_lose_windows_of_their_own_text(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    rows = [(1, passage), (1, other), (2, f"a b {passage}"), (2, f"{other} c"), (2, "x " * 70), (None, passage)]
    got = sorted((r.doc_id or 0, r.n_removed, r.kept.decode()) for r in window_dedup.dedup_windows(docs(spark, rows)).collect())
    assert got == sorted([(1, 0, passage), (1, 0, other), (2, 60, "a b"), (2, 60, "c"), (2, 0, " ".join(["x"] * 70)), (0, 0, passage)])


def test_window_keys_are_a_minimum_over_runs():
    t = pa.array([" ".join(f"k{i % 31}" for i in range(130)), "short", None])
    (row, whole, other, keys), = list(window_dedup.window_keys(t, second=True))
    assert row == 0 and (other[:31] == other[31:62]).all() and not (other == whole).any() and len(whole) == len(keys) == 81 and (keys[:31] == keys[31:62]).all() and (whole[:31] == whole[31:62]).all()


def test_sketch_never_says_less(spark, monkeypatch):
    rows = corpus(7, 80)
    d = docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t"))
    assert window_dedup.cell_bits(d) == window_dedup.LEAST_BITS
    monkeypatch.setattr(window_dedup, "HELD", 500)  # partial sketches of a task add up
    bits = window_dedup.sketch(d.repartition(5), window_dedup.LEAST_BITS)
    seen = {}
    for i, _, _, keys in window_dedup.window_keys(pa.array([t for _, t in rows])):
        for k in set(keys.tolist()):
            seen.setdefault(k, set()).add(i)
    twice = np.array([k for k, v in seen.items() if len(v) > 1], np.uint64)
    assert len(twice) and window_dedup.repeated(bits, twice).all()
    once = np.array([k for k, v in seen.items() if len(v) == 1], np.uint64)
    assert window_dedup.repeated(bits, once).mean() < 0.01


def test_lines(spark):
    run = "alpha\nbeta\n\ngamma\ndelta"
    rows = [(1, f"x\n{run}\ny"), (2, f"p\nq\n{run}"), (3, "alpha\nbeta\nz\ngamma"), (4, "r\nr\nr\nr\nr"), (5, f"{run}\nalpha\nbeta")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "p\nq\n", 3: rows[2][1], 4: "r", 5: "\nalpha\nbeta"}
    # in document 4 the run starts at lines 0, 1 and 2; the later two cover lines 1 to 4


def test_long_lines(spark):
    """With a number of words, passages of one or two lines go too; shorter ones stay."""
    one, two, short = " ".join(f"a{i}" for i in range(50)), "\n\n".join(" ".join(f"{c}{i}" for i in range(25)) for c in "bc"), " ".join(f"d{i}" for i in range(49))
    rows = [(1, one), (2, f"x\n{one}"), (3, two), (4, f"{two}\ny"), (5, short), (6, short), (7, "p\nq\nr"), (8, "p\nq\nr\ns"), (9, one), (10, f"{one}\nz"), (11, f"{one}\nz")]
    want = {i: t for i, t in rows} | {2: "x", 4: "\ny", 8: "s", 9: "", 10: "z", 11: ""}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs(spark, rows), SF).collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert kept == {i: t for i, t in rows} | {8: "s"}


def test_no_later_passage_stays(spark):
    """After the registered query no whole lines of 50 words or more, together, repeat those of an earlier document."""
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    out = line_dedup.dedup_lines(d, words=line_dedup.PASSAGE)
    lines = out.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "x")).withColumn("n", F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+"))).where(f"n >= {line_dedup.PASSAGE}")
    assert lines.groupBy("x").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").isEmpty()
    got = {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op9_winnowed_lines"](spark, SF).collect()}
    own = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"), words=line_dedup.PASSAGE).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    assert got == {r.doc_id: r.h for r in own.collect()}


def test_line_columns(spark):
    d = docs(spark, [(1, "a\nb\nc"), (2, "a\nb\nc\nd")]).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d, n_lines="n", n_removed="gone").collect()}
    assert (got[2].text, got[2].n_chars, got[2].n, got[2].gone) == ("d", 1, 4, 3) and (got[1].n, got[1].gone) == (3, 0)


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 240)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components(edges, {x for e in edges for x in e})
    assert {n: got.get(n, n) for n in want} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
