import io
import json
import math
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import deck, docx, elements, imaging, language, markdown, metrics, ocr, pages, scripts, tables
from quire.plans import pipeline, queries
from quire.sources import files, pdf as pdf_source
from quire.streaming.files import process_stream

from .conftest import SF
from .pdfs import pdf


def els(spark, *rows):
    """Rows (type, text, level) of one document, in order."""
    return spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], "doc_id long, page_num int, pos long, type string, text string, level int")


def test_repeated_texts_need_three_pages(spark):
    def run(n):
        s = spark.createDataFrame([(1, p, k, t, y) for p in range(n) for k, t, y in ((0, "Head ", 10.0), (1, f"body {p}", 50.0), (2, "Foot", 90.0))], "doc_id long, page_num int, span_no int, text string, y0 double")
        return {(r.kind, r.text) for r in pages.repeated_texts(s, s.select("doc_id", "page_num").distinct()).collect()}, s

    assert run(2)[0] == set()
    found, s = run(3)
    assert found == {("header", "Head"), ("footer", "Foot")}
    rep = pages.repeated_texts(s, s.select("doc_id", "page_num").distinct())
    assert pages.strip_repeated(s, rep).count() == 3


def test_density(spark):
    s = spark.createDataFrame([(1, 0, "x", 0.0, 0.0, 10.0, 10.0), (1, 1, " ", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_num int, text string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 0, 100.0, 100.0), (1, 1, 100.0, 100.0), (1, 2, 0.0, 0.0)], "doc_id long, page_num int, width double, height double")
    got = {r.page_num: (r.text_density, r.needs_ocr) for r in pages.page_density(s, p).collect()}
    assert got == {0: (0.01, False), 1: (0.0, True), 2: (0.0, True)}


def test_choose_pages_empty_means_all(spark):
    p = spark.range(3).select(F.col("id").cast("int").alias("page_num"))
    assert pages.choose_pages(p, []).count() == 3 and pages.choose_pages(p, [1, 7]).count() == 1


def test_merge_keeps_pages_apart(spark):
    e = spark.createDataFrame([(1, 0, 0, "paragraph", "a", None), (1, 0, 1, "paragraph", "b", None), (1, 1, 2, "paragraph", "c", None), (1, 1, 3, "title", "T", 1), (1, 1, 4, "paragraph", "d", None)], "doc_id long, page_num int, pos long, type string, text string, level int")
    assert [(r.pos, r.text) for r in elements.merge_paragraphs(e.repartition(3)).orderBy("pos").collect()] == [(0, "a b"), (2, "c"), (3, "T"), (4, "d")]


def test_markdown(spark):
    e = els(spark, ("title", "Test Document", 1), ("heading", "Section 1", 2), ("paragraph", "Words.", None), ("list_item", "• a", 1), ("list_item", "1. b", 1), ("heading", "Deep", 9), ("list_item", "", 1))
    front = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", markdown.frontmatter({"title": F.lit("T")}, {"languages": F.array(F.lit("spa"))}).alias("front"))
    t = spark.createDataFrame([(1, 0, 2, "| a |")], "doc_id long, table_idx int, page_num int, md string")
    got = markdown.markdown(e, front, t, page_markers=True).first().markdown
    assert got == "---\ntitle: T\nlanguages:\n  - spa\n---\n\n\n<!-- Page 1 -->\n\n# Test Document\n\n## Section 1\n\nWords.\n\n- a\n\n1. b\n\n###### Deep\n\n- \n\n## Tables\n\n### Table 1 (Page 3)\n\n| a |\n\n"


def test_decks_on_carry_over_example(spark):
    e = els(spark, ("heading", "S", 1), *[("list_item", f"• bullet {i}", 1) for i in range(20)], ("heading", "T", 2), ("list_item", "- zzz", 1), ("heading", "four", 4), ("list_item", "- yyy", 1))
    text = [(r.type, r.title, len(r["items"])) for r in deck.text_deck_slides(e).orderBy("slide_idx").collect()]
    assert text == [("section", "S", 0), ("content", "T", 8), ("content", "T", 8), ("content", "T", 5), ("content", "T", 1)]
    got = [(r.type, r.title, r["items"]) for r in deck.deck_slides(e).orderBy("slide_idx").collect()]
    assert got == [("cover", "S", None), ("section", "S", None), ("bullets", "T", ["zzz"]), ("bullets", "T", ["yyy"])]
    whole = deck.text_deck(e, "B").first()
    assert whole.deck.startswith("# S\n\n**B**\n\n---\n\n# S\n\n---\n\n## T\n\n") and whole.deck.endswith("Total de slides: 5\n") and whole.slides == 5


def state_machine(rows):
    """A plain model of the JSON deck."""
    out, title, bullets, paras = [], None, [], []

    def flush():
        if title and bullets:
            out.append((title, bullets[:], "\n".join(paras) if paras else None))
        elif title and paras:
            out.append((title, paras[:], None))
        bullets.clear()
        paras.clear()

    for kind, text, level in rows:
        if kind == "heading":
            flush()
            if level == 1:
                out.append(("section", text))
                title = None
            elif level <= 3:
                title = text
        elif title and kind == "list_item" and len(text) > 2:
            bullets.append(text)
            if len(bullets) == 6:
                out.append((title, bullets[:], None))
                bullets.clear()
        elif title and kind == "paragraph" and len(text) > 20:
            paras.append(text)
            if len(paras) == 3:
                out.append((title, paras[:], None))
                paras.clear()
    flush()
    return out


def test_json_deck_against_state_machine(spark):
    rng = np.random.RandomState(1)
    docs = []
    for d in range(60):
        rows = []
        for i in range(rng.randint(1, 50)):
            k = rng.choice(["heading", "list_item", "paragraph", "title"], p=[0.2, 0.4, 0.35, 0.05])
            rows.append((str(k), ("word " * 5 if k == "paragraph" else "item") + f"x{i}", int(rng.randint(1, 6)) if k == "heading" else None))
        docs.append(rows)
    e = spark.createDataFrame([(d, 0, i, *r) for d, rows in enumerate(docs) for i, r in enumerate(rows)], "doc_id long, page_num int, pos long, type string, text string, level int")
    got = {}
    for r in deck.deck_slides(e).where("type <> 'cover'").orderBy("doc_id", "slide_idx").collect():
        got.setdefault(r.doc_id, []).append(("section", r.title) if r.type == "section" else (r.title, r["items"], r.notes))
    assert all(got.get(d, []) == state_machine(rows) for d, rows in enumerate(docs))


def test_deck_json_and_brand(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "Own", "primary": "#111111", "other": 1}))
    brand = files.Brand.read(spark, str(tmp_path / "b.json"), logo="l.png")
    e = els(spark, ("title", "T", 1), ("heading", "S", 1), ("heading", "H", 2), ("list_item", "- one thing", 1))
    t = spark.createDataFrame([(1, 0, "| a |")], "doc_id long, table_idx int, md string")
    info = spark.createDataFrame([(1, "a.pdf", 3, ["spa"])], "doc_id long, source string, pages int, languages array<string>")
    got = json.loads(deck.deck_json(deck.deck_slides(e, t, brand.logo), info, brand.column()).first().json)
    assert got["brand"] == {"name": "Own", "logo": "l.png", "primary": "#111111", "secondary": "#22C55E", "accent": "#06B6D4"}
    assert [s["type"] for s in got["slides"]] == ["cover", "section", "bullets", "table"] and got["slides"][0] == {"type": "cover", "title": "T", "subtitle": "S", "logo": "l.png"}
    assert got["slides"][3]["title"] == "Tabla 1" and got["meta"]["lang"] == ["spa"]


def test_markdown_slides(spark):
    text = "---\na: b\n---\n# 1. Part one\n# 2. Part two\n## Alpha\n" + "".join(f"- bullet {i}\n" for i in range(14)) + "## Beta\n1. number\n| a | b |\n" + "w " * 160 + "\n" + "x" * 310 + "\n"
    got = [(r.type, r.title, r.part, len(r["items"] or [])) for r in scripts.markdown_slides(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("slide_idx").collect()]
    assert got == [("section", "1. Part one", 0, 0), ("content", "Alpha", 0, 8), ("content", "Alpha", 1, 6), ("content", "Beta", 0, 2)]


def test_markdown_deck_text(spark):
    """Cover, sections, slides of eight items with continuations, and the number of main slides."""
    md = "# 1. Part one\n\n## Topic\n\n" + "\n".join(f"- item number {i}" for i in range(18)) + "\n\n## Next topic\n\n- last item\n"
    d = spark.createDataFrame([(7, md), (8, "plain")], "doc_id long, text string")
    got = {r.doc_id: (r.deck, r.slides) for r in scripts.markdown_deck(d, "Brand", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).collect()}
    cover, close = "# Doc {}\n\n**Brand**\n\nFundamentos de Testing de Software\n\n---\n\n", "# Gracias\n\n**Brand**\n\nTotal: {} slides principales\n"
    items = lambda a, b: "".join(f"- item number {i}\n" for i in range(a, b)) + "\n---\n\n"
    body = "# 1. Part one\n\n---\n\n## Topic\n\n" + items(0, 8) + "## Topic (cont.)\n\n" + items(8, 16) + "## Topic (cont.)\n\n" + items(16, 18) + "## Next topic\n\n- last item\n\n---\n\n"
    assert got == {7: (cover.format(7) + body + close.format(3), 3), 8: (cover.format(8) + close.format(0), 0)}


def test_section_slides(spark):
    text = "---\nx\n---\n# 1.2 Two\nold words\n# 1.10 Ten\nwords ten\n# 1.2 Two\n" + "".join(f"item {i}\n" for i in range(9)) + "#### no\n# 1.3 Long\n" + "y" * 600
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.section, r.divider, r.part, len(r["items"])) for r in scripts.section_slides(d).orderBy("section", "part").collect()]
    assert got == [("1.10 Ten", True, 0, 1), ("1.2 Two", True, 0, 8), ("1.2 Two", True, 1, 1), ("1.3 Long", True, 0, 0)]
    whole = scripts.section_deck(d, "Title", "Brand").first()
    assert whole.slides == 6 and whole.deck.index("1.10 Ten") < whole.deck.index("1.2 Two") and "## 1.2 Two (cont.)" in whole.deck


def test_tables(spark):
    rows = [(1, 0, 0, [["a", "b", None], [None, None, None], [" 1 ", "", None]], 0.9, "m"), (2, 0, 0, [["x", None, None], ["1", "2", "3"]], 0.9, "m"), (3, 0, 0, [["x"]], 0.4, "m"), (4, 0, 0, [[None]], 0.9, "m"), (5, 0, 0, [["d", "d"], ["1", "2"]], 0.9, "m")]
    t = spark.createDataFrame(rows, "doc_id long, page_num int, table_idx int, cells array<array<string>>, confidence double, method string")
    got = {r["doc_id"]: (r["columns"], r["cells"]) for r in tables.clean_tables(t).collect()}
    assert got == {1: (["a", "b"], [["1", ""]]), 2: (["0", "1", "2"], [["x", "", ""], ["1", "2", "3"]]), 4: ([], []), 5: (["d", "d"], [["1", "2"]])}
    made = {r["doc_id"]: (r["md"], json.loads(r["js"])) for r in tables.clean_tables(t).select("doc_id", tables.table_markdown(F.col("columns"), F.col("cells")).alias("md"), tables.table_records(F.col("columns"), F.col("cells")).alias("js")).collect()}
    assert made[1] == ("| a | b |\n|---|---|\n| 1 |  |", [{"a": "1", "b": ""}]) and made[4] == ("", []) and made[5][1] == [{"d": "2"}]


def test_table_clean_keeps_every_cell(spark, tmp_path):
    rows = [(5, "a|b|c|d|e|f|g|h\nno marks\n1|2|3|4|5|6|7|8\n9|| |x||||y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.QUERIES["table_clean"](spark, str(tmp_path)).first()
    assert r.columns.split("\x1f") == list("abcdefgh")
    assert [x.split("\x1f") for x in r.cells.split("\x1e")] == [["no marks", *[""] * 7], list("12345678"), ["9", "", "", "x", "", "", "", "y"]]
    assert r.markdown.splitlines()[0] == "| a | b | c | d | e | f | g | h |"


def test_metrics(spark):
    p = spark.createDataFrame([(1, 0, 0.5, None, None), (1, 1, 0.0, 0.0, 4), (1, 2, 0.2, None, None), (1, 3, 0.0, 80.0, 1)], "doc_id long, page_num int, text_density double, ocr_confidence double, corrections long")
    rows = metrics.page_metrics(p)
    assert [(r.native_text_ratio, r.words_corrected) for r in rows.orderBy("page_num").collect()] == [(0.5, 0), (1.0, 4), (0.2, 4), (1.0, 1)]
    assert [r.words_corrected for r in metrics.page_metrics(p, exact=False).orderBy("page_num").collect()] == [0, 4, 0, 1]
    d = metrics.document_metrics(rows)
    assert tuple(d.first()) == (1, 4, 2, 2, 80.0, 9, 0)
    assert len(json.loads(metrics.metrics_json(d, rows).first().json)["page_metrics"]) == 4


def test_recognised_words(spark):
    w = spark.createDataFrame([(1, 0, [("a", 90), (" ", 99), ("b", 10), ("c", -1)]), (2, 0, [])], "doc_id long, page_num int, words array<struct<text:string,confidence:int>>")
    assert {r.doc_id: (r.text, r.ocr_confidence) for r in ocr.recognised_pages(w).collect()} == {1: ("a b", 50.0), 2: ("", 0.0)}


def test_language(spark):
    texts = ["the house of the people is in the town", "corto", "der Hund und die Katze sind nicht da", None, "12345 67890 !!", "", "東京は日本の首都である人口は多い"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"gram": F.lit("x"), "n": F.lit(1), "lang": F.lit("y")})
    got = {r.doc_id: r.languages for r in language.with_languages(d).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "eng", 1: "spa", 2: "deu", 3: "spa", 4: "spa", 5: "spa", 6: "spa"}
    rows = {r.doc_id: r for r in language.scored(d).collect()}
    assert all(abs(sum(s.prob for s in rows[k].scores) - 1) < 1e-6 and len(rows[k].scores) == 9 for k in (0, 2)) and rows[4].scores == [] and rows[1].short and rows[3].short
    assert language.scored(d.limit(0)).count() == 0 and language.scored(d, language.profile(spark).limit(0)).where("size(scores) > 0").count() == 0
    s = {r.doc_id: (r.one, r.es) for r in language.scored(d).select("doc_id", language.language(F.col("short"), F.col("scores")).alias("one"), language.spanish_dominant(F.col("short"), F.col("scores")).alias("es")).collect()}
    assert s[0] == ("eng", False) and s[1] == s[3] == s[4] == ("spa", True)


def test_texts_of_two_languages(spark):
    """The more of a language a text has, the more probable it is."""
    de, en = "der Hund und die Katze sind nicht in dem Haus aber sie werden noch kommen ", "the dog and the cat are not in this house but they will be there "
    d = spark.createDataFrame([(1, de * 9), (2, de * 5 + en * 4), (3, de * 4 + en * 5), (4, de * 9 + en * 10)], "doc_id long, text string")
    got = {r.doc_id: (r.languages, {s.lang: s.prob for s in r.scores}) for r in language.scored(d).select("doc_id", language.languages(F.col("short"), F.col("scores")).alias("languages"), "scores").collect()}
    assert got[1][0] == ["deu"] and got[1][1]["de"] > 0.95
    assert got[1][1]["en"] < got[2][1]["en"] < got[4][1]["en"] < got[3][1]["en"], got
    assert got[2][0][0] == "deu" and got[3][0][0] == got[4][0][0] == "eng" and got[4][1]["de"] > 0.01, got


def test_trigrams_are_counted_without_a_row_each(spark):
    """Texts go through in pieces, in one pass over the rows; rows of one id, null texts and rare characters count as before."""
    pieces = list(language._pieces(pa.array(["ab", None] * 1500)))
    assert [k for k, _ in pieces] == [0, 1024, 2048] and sum(len(x) for _, x in pieces) == 3000
    d = spark.createDataFrame([(1, "en", "ab ab"), (1, "en", "AB, x"), (2, "de", "abc"), (3, None, "abab"), (4, "de", None), (5, "en", "😀𐐨")], "doc_id long, lang string, text string")
    learned = language.learn(d)
    got = {(r.lang, r.gram): r.weight for r in learned.collect()}
    assert set(got) == {("en", " ab"), ("en", "ab "), ("en", " x "), ("en", " 𐐨 "), ("de", " ab"), ("de", "abc"), ("de", "bc ")}
    assert got["en", " ab"] == round(1000 * math.log(3 / 8 / 1e-4))
    out = language.scored(d, learned)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "Join" not in plan
    assert {r.doc_id: len(r.scores) for r in out.collect()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 2}


def test_language_accuracy(spark):
    """Of the four languages of the table, by the built-in model and by one learned from the other half."""
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").where("lang is not null and length(text) > 40").cache()
    learned = language.learn(d.where("doc_id % 2 = 0"))
    for model, least in ((None, 0.97), (learned, 0.99)):
        tested = d.where("doc_id % 2 = 1")
        got = language.with_languages(tested, model).join(tested.select("doc_id", "lang"), "doc_id")
        code = F.create_map(*[F.lit(x) for pair in T.LANGUAGE_CODES.items() for x in pair])
        n, right = got.agg(F.count("*"), F.count_if(F.col("languages")[0] == code[F.col("lang")])).first()
        assert right / n >= least, right / n
    assert learned.groupBy("lang").count().where(f"count > {language.GRAMS}").count() == 0


def test_imaging():
    page = np.full((300, 400), 255, np.uint8)
    for y in range(40, 280, 30):
        page[y : y + 6, 30:370] = 0
    assert imaging.binarise(imaging.denoise(page)).max() == 255 and set(np.unique(imaging.binarise(page))) == {0, 255}
    assert imaging.skew(page, 150) == 0.0
    tilted = imaging.rotate(page, 5)
    assert abs(abs(imaging.skew(tilted, 100)) - 5) <= 1
    assert abs(imaging.skew(imaging.deskew(tilted, votes=100), 100)) <= 1
    assert imaging.resize(page, 144).shape == (600, 800) and imaging.prepare(np.dstack([page] * 3)).shape == page.shape
    assert imaging.contrast(np.tile(np.arange(100, 140, dtype=np.uint8), (64, 2))).std() > 11.6


def test_pdf_round_trip():
    pages_ = [[(50, 800, 18, "F2", "Title (one)"), (50, 700, 10, "F1", "Plain words."), (50, 650, 10, "F3", "Ünïcode ñ"), (50, 600, 10, "F1", "  ")], [(50, 700, 10, "F1", "Second")]]
    for kw in ({}, {"packed": True}, {"packed": True, "predictor": True}):
        rows = pdf_source.decode("p", pdf(pages_, {"Title": "T", "Author": "A"}, [b"\xff\xd8jpeg"], **kw))
        assert [r.get("error") for r in rows] == [None, None], kw
        s = rows[0]["spans"]
        assert [x["text"] for x in s] == ["Title (one)", "Plain words.", "Ünïcode ñ"]
        assert [(x["font_size"], x["is_bold"], x["is_italic"]) for x in s] == [(18.0, True, False), (10.0, False, False), (10.0, False, True)]
        assert rows[0]["metadata"]["title"] == "T" and rows[0]["metadata"]["page_count"] == 2 and rows[0]["metadata"]["subject"] == ""
        assert rows[0]["images"][0]["content"] == b"\xff\xd8jpeg" and (rows[0]["width"], rows[0]["height"]) == (595.0, 842.0)
    assert [r["page_num"] for r in pdf_source.decode("p", pdf(pages_), [1, 9])] == [1]


def test_pdf_errors_are_rows():
    assert "header" in pdf_source.decode("p", b"junk")[0]["error"]
    broken = pdf([[(1, 1, 10, "F1", "kept")]]).replace(b"startxref\n", b"startxref\n9")
    assert pdf_source.decode("p", broken)[0]["spans"][0]["text"] == "kept"
    assert "encrypted" in pdf_source.decode("p", pdf([[]]).replace(b"/Root 1 0 R", b"/Encrypt 3 0 R /Root 1 0 R"))[0]["error"]


def folder(tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    body = [[(50, 820, 9, "F1", "Running head"), (50, 780, 18, "F2", "Report"), (50, 740, 14.5, "F1", "2.1 Part"), (50, 700, 10, "F1", "- first point here"), *[(50, 660 - 14 * i, 10, "F1", f"The words of the text on line {i} are in the page and it is long. " * 2) for i in range(12)]] for _ in range(3)]
    (top / "a.pdf").write_bytes(pdf(body, {"Title": "Report"}))
    (top / "b.PDF").write_bytes(b"not a pdf")
    (top / "c.txt").write_bytes(b"x")
    return top


def test_pipeline(spark, tmp_path):
    top = folder(tmp_path)
    with pytest.raises(ValueError):
        files.pdf_files(spark, str(top / "c.txt"))
    with pytest.raises(ValueError):
        files.pdf_files(spark, str(top / "none"))
    r = pipeline.process_path(spark, str(top), pipeline.Options(export=("md", "json", "docx", "odd")))
    assert [e.path.rsplit("/")[-1] for e in r.errors.collect()] == ["b.PDF"]
    assert not r.elements.where("text = 'Running head'").count() and r.elements.where("type = 'title'").count() == 3
    out = tmp_path / "out"
    seconds = pipeline.write_exports(r, str(out))
    names = {p.name for p in out.iterdir() if not p.name.startswith(".")}
    assert names == {"a.md", "a.gamma.json", "a.docx", "a.metrics.json"}
    assert "languages:\n  - en" in (out / "a.md").read_text() and json.loads((out / "a.metrics.json").read_text())["total_pages"] == 3
    made = json.loads((out / "a.metrics.json").read_text())
    assert made["total_time"] > 0 and abs(sum(p["processing_time"] for p in made["page_metrics"]) - made["total_time"]) < 1e-9 and abs(seconds["decode"] - made["total_time"]) < 1e-6
    assert (out / "a.metrics.json").read_text().startswith('{\n  "') and (out / "a.gamma.json").read_text().startswith('{\n  "brand": {\n    "name": ')
    with zipfile.ZipFile(out / "a.docx") as z:
        ElementTree.fromstring(z.read("word/document.xml"))
    with pytest.raises(pipeline.MissingBackend):
        (top / "d.pdf").write_bytes(pdf([[]]))
        pipeline.process_path(spark, str(top))


def test_pipeline_with_back_ends(spark, tmp_path):
    (tmp_path / "s.pdf").write_bytes(pdf([[]]))
    words = F.array(F.struct(F.lit("1.1").alias("text"), F.lit(80).alias("confidence")), F.struct(F.lit("Heading").alias("text"), F.lit(60).alias("confidence")))
    finder = lambda m, c: lambda p: p.select(F.col("path").alias("doc_id"), F.explode("pages").alias("page_num"), F.lit(0).alias("table_idx"), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))).alias("cells"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    seen = []

    def recogniser(p):
        seen.extend(p.select("width", "height", "languages", "dpi", F.length("pixels").alias("n")).collect())
        return p.select("path", "page_num", words.alias("words"))

    o = pipeline.Options(languages=("fra", "eng"), dpi=72, recogniser=recogniser, table_finders=(finder("x", 0.4), finder("y", 0.9)))
    r = pipeline.process_path(spark, str(tmp_path), o)
    assert [(e.type, e.text, e.level) for e in r.elements.collect()] == [("heading", "1.1 Heading", 2)]
    assert [tuple(x) for x in seen] == [(595, 842, "fra+eng", 72, 595 * 842)]
    with pytest.raises(pipeline.MissingBackend):
        pipeline.process_path(spark, str(tmp_path), pipeline.Options(recogniser=lambda p: p.select("path")))
    assert r.tables.count() == 0 and r.page_metrics.first().ocr_confidence == 70.0  # a poor first finder still goes before the second


def test_docx_levels():
    with zipfile.ZipFile(io.BytesIO(docx.document([("title", "T", 1), ("heading", "H", 12), ("list_item", "1. x & y", None), ("paragraph", "p\x00q", None)], [(["a"], [["1"]], 0)]))) as z:
        xml = z.read("word/document.xml").decode()
    assert all(s in xml for s in ('"Title"', '"Heading9"', "x &amp; y", "pq", "Table 1 (Page 1)")) and ElementTree.fromstring(xml) is not None


def test_stream_equals_batch(spark, tmp_path):
    top = folder(tmp_path)
    q = process_stream(spark, str(top), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    key = lambda d: sorted((r.pos, r.text) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "o/elements"))) == key(pipeline.process_path(spark, str(top)).merged)


def test_html_pages(spark):
    s = files.html_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    assert elements.span_elements(s).groupBy("type").count().count() >= 2 and s.where("text like '%<p>%'").count() == 0
