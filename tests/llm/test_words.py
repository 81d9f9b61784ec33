"""Collocations, SimHash and spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import collocations, queries, simhash, spelling
from tests.conftest import SF
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:5] if len(r) == 3 else (*r, None, None, None) for r in rows], SCHEMA)


def plain_fingerprint(text):
    w = [x.lower() for x in brute.split(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    """{(id, text): (fingerprint, component)}; rows with one id are one node."""
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    known = [x for x in fps if x[0] is not None]
    edges = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if (x ^ y).bit_count() <= 4]
    of = brute.components(edges, {i for i, _ in known})
    return sorted(((i, f"{x:016x}", of.get(i)) for i, x in fps), key=str)


def simhashed(d):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()), key=str)


def some_texts(seed=4, n=160):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = rng.choice(out).split(" ") if out and rng.random() < 0.6 else [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append(" ".join(w))
    return list(enumerate(out))


def test_simhash_against_brute_force(spark):
    rows = some_texts()
    got = simhashed(docs(spark, rows))
    assert got == plain_simhash(rows) and len({c for _, _, c in got}) < len(rows) - 20


def test_simhash_on_the_test_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_deletion_variant_simhash"](spark, SF).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == plain_simhash(rows)


@pytest.mark.parametrize("radius", [2, 4, 7])
def test_every_pair_within_the_radius_has_a_variant_in_common(spark, radius):
    rng = random.Random(radius)
    pairs = []
    for k in range(200):
        a = rng.getrandbits(64)
        pairs.append((k, a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 1)))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(k, signed(x)) for k, *ab in pairs for x in ab], "k long, fp long")
    shared = rows.select("k", F.explode(F.array_distinct(simhash.variants(radius))).alias("key")).groupBy("k", "key").count().where("count = 2").select("k").distinct()
    differ = {k for k, a, b in pairs if a != b}
    assert differ <= {r.k for r in shared.collect()} and len(simhash.segments(radius)) == radius // 2 + 1


@pytest.mark.parametrize("tile", [3, 20])
def test_large_buckets_lose_no_link(spark, monkeypatch, tile):
    """Clusters, a chain, and loose fingerprints of one segment, in blocks of a few."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << a) ^ (1 << b) for a in range(0, 12) for b in range(a)}
    chain = base
    for b in range(22, 60, 2):
        chain ^= 0b11 << b
        prints.add(chain)
    prints |= {(base & ((1 << 21) - 1)) | (rng.getrandbits(43) << 21) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in got)
    want = brute.components([(a, b) for a, x in zip(signed, prints) for b, y in zip(signed, prints) if a < b and (x ^ y).bit_count() <= 4], signed)
    assert brute.components(got, signed) == want and len(got) < 40 * len(prints)


def test_simhash_edge_cases(spark):
    long = " ".join(f"v{i % 977}" for i in range(400000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, long), (7, long), (4, "a b"), (None, None), (8, "q " * 60), (8, "a b"), (9, "q Q q\tq q")]
    d = docs(spark, rows)
    for c in ("id", "t", "fp", "key", "rep", "component"):
        d = d.withColumn(c, F.lit("x"))
    assert simhashed(d) == plain_simhash(rows) and simhash.near_duplicates(d.limit(0)).count() == 0
    assert {r[2] for r in simhashed(d) if r[0] in (1, 2, 3)} == {1} and {r[2] for r in simhashed(d) if r[0] in (4, 5, 8, 9)} == {4}


def plain_words(rows):
    """{word: n} of (id, text)."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(rows):
    n = plain_words(rows)
    having = {}  # words one character apart share a text with one character out
    for w in n:
        for x in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            having.setdefault(x, []).append(w)
    near = {w: set() for w in n}
    for own in having.values():
        for a in own:
            near[a] |= {b for b in own if edit_one(a, b)}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def varied(d):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(d).collect())


def test_spelling_against_brute_force(spark):
    """Few letters, so that words have very many neighbours of every kind."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abÀ") for _ in range(rng.randrange(6, 10))) for _ in range(12)]
    while len(vocabulary) < 160:
        w, k = rng.choice(vocabulary), rng.randrange(9)
        vocabulary.append(w[:k] + rng.choice(("", "a", "b", "À")) + w[k + rng.randrange(2) :])
    weights = [rng.choice((1, 1, 9, 81, 700)) for _ in vocabulary]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=900))) for i in range(90)]
    want = plain_variants(rows)
    assert varied(docs(spark, rows)) == want
    assert sum(x[4] for x in want) > 150 and sum(x[1] is not None and x[2] != x[1] for x in want) > 2


def test_spelling_on_the_test_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_errata_trie_spelling"](spark, SF).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_variants(rows)


def test_spelling_without_broadcast_nodes(spark, monkeypatch):
    """Nodes are joined alike whether they are broadcast or shuffled."""
    monkeypatch.setattr(spelling, "TOP", 1)
    rows = [(i, "running runing runnning running cunning sunning 1running2runninG") for i in range(12)]
    assert varied(docs(spark, rows)) == plain_variants(rows)


def test_light_edges_are_few(spark):
    """A word has at most log2(words) light edges and one for its end."""
    rows = [(i, " ".join(f"{a}{b}{c}xyzxyz" for a in "abcd" for b in "abcdefgh" for c in "abcdefgh")) for i in range(6)]
    v = spelling.words(docs(spark, rows))
    most = max(r["count"] for r in spelling.light_edges(v).groupBy("h").count().collect())
    assert most <= np.log2(v.count()) + 1


def test_spelling_edge_cases(spark):
    long = "ab" * 1500
    rows = [(1, None), (2, ""), (None, "Ölwechsel " * 5), (3, f"{long} {long}x " * 6), (4, "ÀÁÂÃÄÅ ÀÁÂÃÄÅ ÀÁÂÃÄÅ ÀÁÂÃÄÅ ÀÁÂÃÄÅ"), (5, "short" * 9), (6, "aaaaaa aaaaaaa " * 5), (6, "aaaaaa aaaaaaa " * 5), (None, None)]
    d = docs(spark, rows)
    for c in ("id", "t", "word", "n", "h"):
        d = d.withColumn(c, F.lit("x"))
    assert varied(d) == plain_variants(rows) and spelling.spelling_variants(d.limit(0)).count() == 0
    assert varied(docs(spark, [(1, "a b c")])) == []
    very = "abc" * 100000  # a long word is one row for each of its characters
    got = varied(docs(spark, [(i, f"{very} {very}x {very[1:]}") for i in range(3, 9)]))
    assert [(x[4], x[1]) for x in got] == [(2, None), (1, None), (1, None)]


def plain_collocations(rows, least=100, first=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of (id, text, lang)."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    gone = {(p[0], *p[i:j]) for p, c in often.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and f[(p[0], *p[i:j])] <= c}
    out = {}
    for p, a in often.items():
        if p not in gone:
            lang, *w = p
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, rank + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in out.items() for rank, x in enumerate(sorted(own)[:first]))


def collocated(d, **options):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(d, **options).collect())


def sentences(seed=9, n=300):
    rng, out = random.Random(seed), []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(30)):
            w += rng.choice(("New York City", "the", "of the", "a a", "the big apple pie recipe today", f"x{rng.randrange(40)}", "ok.", "so,", "end\n", "\ttab")).split(" ")
        out.append((i, " ".join(w), rng.choice(("en", "de", None))))
    return out


@pytest.mark.parametrize("hot", [1, 30, 1 << 14])
def test_collocations_against_brute_force(spark, monkeypatch, hot):
    """However prefixes are dealt."""
    monkeypatch.setattr(collocations, "HOT", hot)
    rows = sentences()
    want = plain_collocations(rows, 20, 25)
    assert collocated(docs(spark, rows), least=20, first=25) == want and {x[0] for x in want} == {"en", "de", "und"} and max(len(x[2].split()) for x in want) == 5


def test_collocations_through_full_filters(spark, monkeypatch):
    """Filters that let everything through change nothing."""
    monkeypatch.setattr(collocations, "holds", lambda bits, at: np.ones(len(at), bool))
    monkeypatch.setattr(collocations, "_HELD", 50)
    rows = sentences(10, 80)
    assert collocated(docs(spark, rows), least=9) == plain_collocations(rows, 9)


def test_collocations_edge_cases(spark):
    long = "alpha beta gamma " * 60000
    odd = "a\x01 b a\x00 b a b c\x02 a b c "
    rows = [(1, None, "en"), (2, "", None), (3, long, "fr"), (4, odd * 120, "en"), (4, odd * 120, "en"), (5, "é è " * 120, None), (6, " \t \n", "de"), (None, "z z " * 60, ""), (7, "x" * 500000, "en")]
    d = docs(spark, rows)
    for c in ("word", "h", "n", "t", "pointer", "phrase"):
        d = d.withColumn(c, F.lit("x"))
    got = collocated(d)
    assert got == plain_collocations(rows) and any("\x01" in x[2] for x in got)
    assert collocations.collocations(d.limit(0)).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    rows = [(1, "p q. " * 150 + "r. " * 400 + "p. " * 11 + "q. " * 7, "en")]
    big = 7 * 10**12
    phrases, totals = collocations.frequent_phrases(docs(spark, rows))
    scaled = phrases.withColumn("n", F.col("n") * big), totals.withColumn("total", F.col("total") * big)
    keep, collocations.frequent_phrases = collocations.frequent_phrases, lambda *a: scaled
    try:
        (r,) = collocations.collocations(docs(spark, rows)).collect()
    finally:
        collocations.frequent_phrases = keep
    assert (r.a, r.score) == (150 * big, 1000 * 150 * 718 // (161 * 157))
