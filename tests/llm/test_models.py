import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, license_scan, mih, mixing, mtree, packing, quality, queries
from quire.llm._text import CHUNK
from tests.conftest import SF

ODD = [(1, None), (2, ""), (3, " \n"), (4, "words of a text"), (4, "words of a text"), (None, "words"), (5, "12 34 !!"), (6, "w" * 300000), (7, "x y " * 100000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("i", "t", "y", "held_out", "size", "u", "batch", "n_tokens", "x")})


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_hyperdimensional_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_language_edge_cases(spark):
    d = odd(spark)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(d, langid.learn(d.where("doc_id in (4, 6)"))).collect()]
    assert sorted(got, key=str) == sorted([(i, "und" if not t or not any(c.isalpha() for c in t) else "en") for i, t in ODD], key=str)
    none = langid.learn(d.limit(0))
    assert {r.lang_pred for r in langid.identify(d, none).collect()} == {"und"} and langid.identify(d.limit(0), none).count() == 0


def test_every_language_is_learned(spark):
    d = spark.createDataFrame([(k, f"{chr(0x4E00 + k)}ab" * 3, f"l{k:03}") for k in range(300)] + [(300, "xyz", None)], "doc_id long, text string, lang string")
    names, protos = langid.learn(d)
    assert names == [f"l{k:03}" for k in range(300)] and protos.shape == (300, langid.DIM) and (protos != 0).any(1).all()


def test_bundles_bind_and_permute():
    a, b = langid.bundle("abc"), langid.bundle("cba")
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) < 0.3 and (langid.bundle("ABC") == a).all() and langid.bundle("123") is None
    both = langid.bundle("abc abc abc")
    assert both @ a / np.linalg.norm(a) / np.linalg.norm(both) > 0.9


def test_bundles_against_the_definition():
    """Sums of products of rotated letter vectors, letter by letter, in any alphabet."""
    letters = langid.Letters(64)

    def plain(text):
        marks = [c.lower()[0] if c.isalpha() else " " for c in f" {text} "]
        marks = [c for k, c in enumerate(marks) if c != " " or k == 0 or marks[k - 1] != " "]
        vec = [langid._gap(64) if c == " " else letters.vector(ord(c)) for c in marks]
        return sum(np.roll(a, 2).astype(int) * np.roll(b, 1) * c for a, b, c in zip(vec, vec[1:], vec[2:]))

    for text in ("Ab ab, ab!", "naïve Straße", "日本語 の text", "Ωμέγα λόγος", "ДОМ дом", "a", "𐐀𐐨 x"):
        assert (langid.bundle(text, 64) == plain(text)).all()
    far = langid.bundle("привет"), langid.bundle("тривер"), langid.bundle("é"), langid.bundle("e")
    assert abs(far[2] @ far[3]) < 0.3 * langid.DIM and abs(far[0] @ far[1]) < 0.8 * np.linalg.norm(far[0]) * np.linalg.norm(far[1])


def test_languages_against_brute_force(spark):
    """Every document goes to the prototype with the largest cosine."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, protos = langid.learn(d)
    sums = {}
    for _, t, lang in rows:
        if lang and (v := langid.bundle(t)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    assert names == sorted(sums) and all(np.allclose(protos[k], sums[n] / np.linalg.norm(sums[n])) for k, n in enumerate(names))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, (names, protos)).collect()}
    for i, t, _ in rows:
        v = langid.bundle(t)
        cos = [] if v is None else [float(p @ v / np.linalg.norm(v)) for p in protos]
        assert got[i][0] == ("und" if v is None else names[int(np.argmax(cos))]) and abs(got[i][1] - (max(cos) if cos else 0)) < 1e-4


def plain_features(text):
    """Two of the features, word by word: neighbours that are equal, and distinct words of 256-word windows."""
    w = (text or "").split()
    if not w:
        return 0.0, 0.0
    parts = [w[k : k + 256] for k in range(0, len(w) // 256 * 256, 256)] + ([w[-256:]] if len(w) % 256 and len(w) > 256 else []) if len(w) >= 256 else [w]
    return (sum(a == b for a, b in zip(w, w[1:])) / len(w)) ** 0.5, 1 - np.mean([len(set(p)) for p in parts]) / len(parts[0])


def test_quality_against_brute_force(spark):
    """Scores are the logistic function of weights times features, computed text by text; features are those of the definition."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w, t = quality.learn(d, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(d, (w, t)).collect()}
    at = quality._CLASSES
    for i, text in rows:
        x = quality.features(pa.array([text]))[0]
        assert np.allclose(x[at : at + 2], plain_features(text))
        for ch in ".,!|":
            n = len((text or "").encode())
            assert np.isclose(x[quality._MARKS.index(ord(ch))], (((text or "").count(ch)) / max(n, 1)) ** 0.5)
        assert np.isclose(got[i], 1 / (1 + np.exp(-(x @ w - t + np.log(0.3 / 0.7)))))


def test_fit_against_gradient_descent():
    """All pairs of a good and a bad row, by plain steps down the loss; the threshold leaves as many rows below as are bad."""
    rng = np.random.RandomState(5)
    x = rng.randn(70, 3)
    y = (x @ [1.5, -1, 0.2] + rng.randn(70) > 0.4).astype(int)
    d = np.array([g - b for g in x[y == 1] for b in x[y == 0]])
    want = np.zeros(3)
    for _ in range(4000):
        want -= 0.5 * (-(d / (1 + np.exp(d @ want))[:, None]).mean(0) + 1e-3 * want)
    w, t = quality.fit(x, y, pairs=400000)
    assert np.allclose(w, want, rtol=0.03, atol=0.02), (w, want)
    assert (x @ w < t).sum() == (y == 0).sum()


def test_learning_takes_labelled_rows_only(spark):
    """The rows that count are those with a label of 0 or 1, each once, whatever their order."""
    d = spark.createDataFrame([(i, ("good words " if i % 2 else "bad!!! ") * (3 + i)) for i in range(40)] + [(99, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, None), (None, 1), (3, 7)], "doc_id long, quality int")
    w, t = quality.learn(d, labels)
    texts = [("good words " if i % 2 else "bad!!! ") * (3 + i) for i in range(40)]
    x = quality.features(pa.array(texts))
    order = np.lexsort(x.T)
    plain = quality.fit(x[order], np.array([i % 2 for i in range(40)])[order])
    assert np.allclose(w, plain[0]) and np.isclose(t, plain[1])
    again = quality.learn(d.repartition(7).union(d.limit(3)), labels)
    assert np.allclose(again[0], w) and np.isclose(again[1], t)


def test_quality_on_held_out(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_bradley_terry_quality"](spark, SF).collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows if r.held_out and r.doc_id in label]) > 0.9


def test_quality_edge_cases(spark):
    d = odd(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (7, 1)], "doc_id long, quality int")
    model = quality.learn(d, labels)
    rows = quality.score(d, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and {r.predicted for r in rows if r.doc_id == 5} == {0}
    kept = quality.score(d, model, keep=True)
    assert kept.columns == d.columns and 5 not in {r.doc_id for r in kept.collect()}
    for one in (0, 1):  # labels of one kind only: all alike
        m = quality.learn(d, labels.where(f"quality = {one}"))
        assert {r.predicted for r in quality.score(d, m).collect()} == {one}
    assert quality.score(d.limit(0), model).count() == 0


def test_features_do_not_depend_on_the_batch():
    t = pa.array(["abc def\nghi", "", None, "x!! " * 500, "a" * (CHUNK + 5)], pa.string())
    assert np.allclose(quality.features(t), np.vstack([quality.features(t.slice(i, 1)) for i in range(len(t))]))


def test_repetition_reads_the_tail():
    head = [f"w{i}" for i in range(256)]
    at = quality.FEATURES - 4
    for n in (1, 100, 255):
        clean, junk = quality.features(pa.array([" ".join(head + [f"v{i}" for i in range(n)]), " ".join(head + [head[-1]] * n)]))[:, at]
        assert clean == 0 and np.isclose(junk, n / 512)
    short, whole = quality.features(pa.array(["a a b", " ".join(head + head)]))[:, at]
    assert np.isclose(short, 1 / 3) and whole == 0


def test_bradley_terry_orders_pairs():
    rng = np.random.RandomState(0)
    x = rng.randn(400, 3)
    y = (x @ [2, -1, 0] + 0.1 * rng.randn(400) > -1.5).astype(int)
    w, t = quality.fit(x, y, pairs=5000)
    assert np.mean((x @ w > t) == (y == 1)) > 0.95 and w[0] > 0 > w[1]


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix(d.repartition(9)).collect()}
    assert len(got) == 3000 and again == {(r.doc_id, r.copies) for r in got} and all(0 <= r.copies <= 3 for r in got)
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    # targets by resharing step by step
    weight, total, full = {"a": 1, "b": 2, "c": 3, None: 1}, sum(size.values()), {}
    while True:
        left, w = total - sum(full.values()), sum(v for s, v in weight.items() if s not in full)
        share = {s: left * v / w for s, v in weight.items() if s not in full}
        over = {s: 3 * size[s] for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target = full | share
    for s in size:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - target[s]) < 1e-6 * total and own[0].source_size == size[s]
        assert abs(sum(r.copies * r.size for r in own) - target[s]) <= 60


def test_inclusion_odds_decide(spark):
    """Longer documents are taken more often, and not those with the smallest numbers."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 30, 400])), "a" if i % 2 else "b") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, weights=(1, 9))
    got = got.join(d.select("doc_id", mixing._uniform(F.col("doc_id"), F.col("text")).alias("u")), "doc_id").where("source = 'a'").collect()
    assert {r.copies for r in got} == {0, 1}
    share = {n: np.mean([r.copies for r in got if r.size == n]) for n in (1, 3, 30, 400)}
    level = share[400] / 9
    assert all(abs(share[n] - level * m) < 0.06 for n, m in ((1, 1), (3, 2), (30, 5))) and share[1] < share[3] < share[30] < share[400]
    by_u = sorted(got, key=lambda r: r.u)
    assert [r.copies for r in by_u] != sorted([r.copies for r in by_u], reverse=True)


def test_sizes_and_levels_of_a_source(spark):
    """Expected copies stop at the cap, and null ids draw by their texts."""
    d = spark.createDataFrame([(None, " ".join([f"w{i}"] * 5), "a") for i in range(300)] + [(i, "v " * 300, "b") for i in range(100)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    own = [r for r in got if r.source == "a"]
    assert {r.copies for r in own} == {3} and {r.target for r in own} == {4500.0}
    got = mixing.mix(d, weights=(1, 40)).where("source = 'a'").collect()
    assert 0 < sum(r.copies for r in got) < 300 and abs(sum(r.copies * r.size for r in got) - got[0].target) <= 5


def test_mixing_edge_cases(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    empty = odd(spark).where("doc_id in (1, 2)")
    assert {(r.target, r.copies) for r in mixing.mix(empty).collect()} == {(0.0, 0)} and mixing.mix(empty.limit(0)).count() == 0


def test_bucket_bounds_against_brute_force():
    from itertools import combinations

    rng = np.random.RandomState(2)
    for _ in range(30):
        lengths = np.unique(rng.randint(0, 50, 8))
        counts = rng.randint(1, 9, len(lengths))
        for buckets in (1, 2, 3, 20):
            cost = lambda bounds: sum(n * min(b for b in bounds if b >= v) for v, n in zip(lengths, counts, strict=True))
            best = min(cost([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
            got = packing.boundaries(lengths, counts, buckets)
            assert cost(got) == best and len(got) <= buckets and got[-1] == lengths[-1]


def test_bucket_bounds_of_many_lengths():
    """Against the program that tries every earlier boundary; lengths and counts of very different sizes."""
    rng = np.random.RandomState(7)
    for n in (1, 2, 40, 300):
        lengths = np.unique(np.exp(rng.rand(n) * 12).astype(int))
        counts = rng.randint(1, 10**6, len(lengths)) ** rng.randint(1, 3, len(lengths))
        rows = np.concatenate(([0], np.cumsum(counts))).astype(object)
        for buckets in (1, 3, 16):
            best = [0] + [10**30] * len(lengths)
            for _ in range(buckets):
                best = [0] + [min(best[i] + (rows[j] - rows[i]) * int(lengths[j - 1]) for i in range(j)) for j in range(1, len(lengths) + 1)]
            got = packing.boundaries(lengths, counts, buckets)
            assert sum(int(c) * min(b for b in got if b >= v) for v, c in zip(lengths.tolist(), counts.tolist(), strict=True)) == best[-1]
            assert len(got) <= buckets and got == sorted(set(got)) and got[-1] == lengths[-1]


def test_equal_rows_are_packed_one_by_one(spark):
    d = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(3).alias("n"))
    rows = packing.pack(d, F.col("n"), 4, 30).collect()
    assert sorted((r.batch, r.place) for r in rows) == [(b, p) for b in range(500) for p in range(10)]


def test_packing(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, rng.choice([rng.randrange(0, 400), rng.randrange(0, 9000)])) for i in range(5000)], "doc_id long, n int").withColumn("n", F.when(F.col("doc_id") % 97 == 0, None).otherwise(F.col("n")))
    rows = packing.pack(d, F.col("n"), 8, 8192).collect()
    assert len(rows) == 5000 and len({r.bucket_len for r in rows}) <= 8 and all(r.n_tokens <= r.bucket_len for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.bucket_len, {}).setdefault(r.batch, []).append(r.place)
    for length, batches in by.items():
        most = max(1, 8192 // max(length, 1))
        assert sorted(batches) == list(range(len(batches))) and all(sorted(p) == list(range(len(p))) for p in batches.values())
        assert all(len(p) == most for b, p in batches.items() if b < len(batches) - 1)


def test_packing_edge_cases(spark):
    from quire.llm._spark import word_count

    d = odd(spark)
    rows = packing.pack(d, word_count(F.col("text"))).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id == 7} == {200000}
    assert packing.pack(d.limit(0), word_count(F.col("text"))).count() == 0 and packing.pack(d.where("doc_id = 1"), word_count(F.col("text"))).first().bucket_len == 0


def test_licenses(spark):
    mit = "Copyright (c) X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"), to deal in the Software without restriction,\nincluding without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE\nWARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    keep, grant = mit.split("\n\n")[2], mit.split("\n\n")[1]
    rows = [(1, "text |\nLicensed under the Apache License, Version 2.0."), (2, mit), (3, keep + "\n\n" + grant), (4, "Some words. Released under the MIT License. Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "license"), (8, "É Released under the MIT license")]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit(1))).collect()}
    assert got == {1: (1, "Apache-2.0"), 2: (3, "MIT"), 3: (2, ""), 4: (2, "CC-BY-NC-4.0 MIT"), 5: (0, ""), 6: (0, ""), 7: (0, ""), 8: (1, "MIT")}  # other letters separate
    assert license_scan.licenses(odd(spark)).count() == len(ODD) and license_scan.licenses(odd(spark).limit(0)).count() == 0


#: Notices as files state them.
NOTICES = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_notices_in_comments(spark, mark):
    """After a copyright line without a full stop, with and without an empty comment line between."""
    rows = []
    for name, text in NOTICES.items():
        for k, gap in enumerate(("", "\n")):
            body = f"Copyright (c) 2020 Some People, all of them\n{gap}{text}"
            rows.append((name, "\n".join((mark + line).rstrip() for line in body.split("\n"))))
    got = license_scan.licenses(spark.createDataFrame(rows, "name string, text string"), "name").collect()
    assert [r.licenses for r in sorted(got, key=lambda r: r.doc_id)] == sorted(n for n, _ in rows)


@pytest.mark.parametrize("mark", ["\n", "\n * ", "\r\n// ", "\n# "])
def test_every_sentence_however_it_is_wrapped(spark, mark):
    """At each space, and at all of them."""
    from quire.llm import license_scan

    rows = []
    for i, s in license_scan.SENTENCES.items():
        w = s.split(" ")
        wrapped = [" ".join(w[:k]) + mark + " ".join(w[k:]) for k in range(1, len(w))] + [mark.join(w), s]
        rows += [(i, mark + x.capitalize() + ".") for x in wrapped]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id string, text string"))
    assert [(r.doc_id, r.sentences) for r in got.where("doc_id <> sentences or n_sentences <> 1").collect()] == []
    only = {"x": "lorem ipsum dolor", "y": "mpl and so on"}
    assert license_scan.hints(only) == ["mpl", "lorem"] and all(any(h in s for h in license_scan.hints(license_scan.SENTENCES)) for s in license_scan.SENTENCES.values())
    found = license_scan.licenses(spark.createDataFrame([(1, "Lorem" + mark + "ipsum dolor.")], "doc_id long, text string"), sentences=only, rules=(("X", ("x",)),)).first()
    assert (found.sentences, found.licenses) == ("x", "X")


def test_given_rules(spark):
    d = spark.createDataFrame([(1, "First thing. Other words. Second thing!"), (2, "Second thing. First thing."), (3, None)], "doc_id long, text string")
    own = {"one": "first thing", "two": "second thing"}
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in license_scan.licenses(d, sentences=own, rules=[("X", ("one", "two")), ("Y", ("two",))], instead={"X": "Y"}).collect()}
    assert got == {1: (2, "X"), 2: (2, "Y"), 3: (0, "")}
    assert {r.licenses for r in license_scan.licenses(d, rules=()).collect()} == {""}


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(x)), x, strict=True)], "vec_id long, embedding array<float>")


def exact(x, k, every=20, floor=True):
    v = np.floor(64 * x.astype(np.float32).astype(float)) if floor else x.astype(np.float32).astype(float)
    out = []
    for q in range(0, len(v), every):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:k]
        out += [(q, n + 1, i, s[i]) for n, i in enumerate(order)]
    return out


@pytest.mark.parametrize("kind", ["normal", "clustered", "ties", "lengths"])
def test_mtree_is_exact(spark, kind):
    rng = np.random.RandomState(0)
    x = rng.randn(900, 6)
    if kind == "clustered":
        x = x * 0.1 + rng.randn(9, 6)[rng.randint(0, 9, 900)] * 3
    elif kind == "ties":
        x = rng.randint(-1, 2, (900, 6)) / 4
    elif kind == "lengths":
        x *= np.exp(rng.randn(900, 1))
    got = sorted(tuple(r) for r in mtree.top_k(table(spark, x.tolist()), block=200).collect())
    assert got == exact(x, 20)


def test_mtree_passes_over_entries():
    rng = np.random.RandomState(1)
    x = np.round(rng.randn(50, 4)[rng.randint(0, 50, 20000)] * 100 + rng.randn(20000, 4))
    t = mtree.MTree(np.arange(len(x)), x, float((x * x).sum(1).max()), page=64)
    ids, scores = t.search(0, x[0], 10)
    s = x @ x[0]
    s[0] = -np.inf
    assert sorted(scores) == sorted(np.sort(s)[-10:]) and t.computed < 0.2 * len(x)


@pytest.mark.parametrize("f", [mtree.top_k, mih.nearest])
def test_vector_edge_cases(spark, f):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [2.0]), (7, [0.0, 0.0]), (20, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "x", "region", "score")})
    got = {(r.query_id, r.vec_id) for r in f(d).collect()}
    others = {5, 6} | ({7} if f is mtree.top_k else set())
    assert got == {(0, v) for v in others | {20}} | {(20, v) for v in others | {0}}
    assert f(d.limit(0)).count() == 0 and f(d.where("vec_id = 0")).count() == 0


def test_equal_vectors_tie_by_id(spark):
    """Copies of a vector of rounded components have one score, wherever they are stored."""
    rng = np.random.RandomState(6)
    base = rng.randn(40, 33).astype(np.float32)
    x = base[rng.randint(0, 40, 800)]
    rows = mih.nearest(table(spark, x.tolist()), k=60, block=170).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == sorted(((r.vec_id, r.score) for r in own), key=lambda r: (-r[1], r[0]))
        for r in own:
            assert len({s.score for s in own if (x[s.vec_id] == x[r.vec_id]).all()}) == 1


def test_radius_grows_for_queries_that_lack_neighbours(spark):
    rng = np.random.RandomState(9)
    x = np.vstack([rng.randn(400, 16) * 0.05 + rng.randn(16), rng.randn(20, 16) * 3])[rng.permutation(420)]
    rows = mih.nearest(table(spark, x.tolist()), every=7, recall=0.0, block=150).collect()
    assert len(rows) == 60 * 20


def test_recall_on_the_test_data(spark):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {(r.query_id, r.vec_id) for r in mih.op2_multi_index_hashing(spark, SF.replace("0.001", "0.01")).collect()}
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want |= {(ids[i], v) for v in ids[np.argsort(-s, kind="stable")[:20]]}
    assert len(got & want) >= 0.9 * len(want)


def test_large_scores_are_whole(spark):
    """Sums beyond 2**53 are exact."""
    rng = np.random.RandomState(3)
    x = rng.randint(-(2**22), 2**22, (300, 40)).astype(float)
    got = [tuple(r) for r in mtree.top_k(table(spark, x.tolist()), every=50, block=90).collect()]
    v = [[int(64 * c) for c in row] for row in x.astype(np.float32).tolist()]
    want = []
    for q in range(0, 300, 50):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(300) if i != q)[:20]
        want += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s)]
    assert sorted(got) == want and max(abs(w[3]) for w in want) > 2**53


def test_probing_retrieves_the_whole_ball():
    rng = np.random.RandomState(4)
    c = rng.randint(0, 65536, (3000, 4)).astype(np.uint16)
    index = mih.MultiIndex(c)
    for r in (0, 3, 8, 11, 19, 27, 64):
        q = c[rng.randint(3000)] ^ np.uint16(1 << rng.randint(16))
        assert set(index.probe(q, r)) == set(np.flatnonzero(mih.distance(c, q) <= r))


@pytest.mark.parametrize("unit", [True, False])
def test_recall(spark, unit):
    rng = np.random.RandomState(5)
    x = rng.randn(3000, 32) + 2 * rng.randn(10, 32)[rng.randint(0, 10, 3000)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    rows = mih.nearest(table(spark, x.tolist()), block=1000).collect()
    want = exact(x, 20, floor=False)
    hits = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(want) and len(hits) >= 0.9 * len(want)
    score = {(q, i): s for q, _, i, s in want}
    assert all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-9 for r in rows if (r.query_id, r.vec_id) in score)
