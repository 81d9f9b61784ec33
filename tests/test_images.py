"""Images among elements, and their slides."""

import json

from pyspark.sql import functions as F

from quire.operators import deck, elements
from quire.plans import pipeline
from tests.pdfs import pdf

ELEMENTS = "doc_id long, page_num int, pos long, type string, text string, level int, y0 double"
IMAGES = "doc_id long, page_num int, y0 double, image string"


def test_images_are_below_the_last_element_above(spark):
    e = spark.createDataFrame([(1, 0, 0, "heading", "H", 1, 10.0), (1, 0, 1, "paragraph", "p", None, 50.0), (1, 2, 2, "heading", "I", 2, 30.0), (1, 3, 3, "paragraph", "recognised", None, None)], ELEMENTS)
    rows = [(1, 0, 5.0, "top"), (1, 0, 10.0, "b"), (1, 0, 10.0, "a"), (1, 0, 90.0, "c"), (1, 1, 1.0, "next page"), (1, 2, 29.0, "d"), (1, 3, 0.0, "e"), (2, 0, 1.0, "no element")]
    got = {r.image: (r.pos, r.nth) for r in elements.place_images(spark.createDataFrame(rows, IMAGES), e).collect()}
    assert got == {"top": (-1, 1), "a": (0, 2), "b": (0, 3), "c": (1, 4), "next page": (1, 5), "d": (1, 6), "e": (3, 7), "no element": (-1, 1)}
    assert elements.place_images(spark.createDataFrame([], IMAGES), e).count() == 0


def test_image_slides(spark):
    long = "a paragraph of more than twenty characters"
    e = spark.createDataFrame([(1, 0, 0, "title", "Deck", 1, 0.0), (1, 0, 1, "heading", "Part", 2, 10.0), (1, 0, 2, "paragraph", long, None, 20.0), (1, 1, 3, "heading", "Deep", 5, 10.0), (1, 1, 4, "paragraph", long, None, 20.0), (3, 0, 0, "paragraph", long, None, 20.0)], ELEMENTS)
    images = spark.createDataFrame([(1, 0, 5.0, "one.png"), (1, 0, 15.0, "two.png"), (1, 1, 25.0, "three.png"), (2, 0, 1.0, "lost.png"), (3, 0, 0.0, "four.png")], IMAGES)
    s = deck.deck_slides(e, images=elements.place_images(images, e))
    got = {(r.doc_id, r.slide_idx): (r.type, r.title, r.image) for r in s.collect()}
    assert got == {
        (1, 0): ("cover", "Deck", None), (1, 1): ("image", "Deck", "one.png"), (1, 2): ("image", "Part", "two.png"), (1, 3): ("bullets", "Part", None), (1, 4): ("image", "Deep", "three.png"), (1, 5): ("bullets", "Part", None),
        (3, 0): ("cover", "Untitled Presentation", None), (3, 1): ("image", "Untitled Presentation", "four.png"),
    }
    plain = deck.deck_slides(e)
    assert plain.where("type = 'image'").count() == 0 and plain.count() == 4


def test_images_are_exported(spark, tmp_path):
    """Images become files, and slides that name them."""
    body = [[(50, 780, 18, "F2", "Report"), (50, 740, 14.5, "F1", "Part of it"), *[(50, 600 - 14 * i, 10, "F1", f"The words of the text on line {i} are in the page and it is long. " * 2) for i in range(12)]]] * 2
    (tmp_path / "a.pdf").write_bytes(pdf(body, images=[b"\xff\xd8jpeg"]))
    r = pipeline.process_path(spark, str(tmp_path), pipeline.Options(export=("json",), images=True))
    out = tmp_path / "out"
    pipeline.write_exports(r, str(out))
    assert {p.name for p in out.iterdir() if not p.name.startswith(("_", "."))} == {"a.gamma.json", "a.metrics.json", "a.p1-1.jpeg", "a.p2-1.jpeg"}
    assert (out / "a.p2-1.jpeg").read_bytes() == b"\xff\xd8jpeg"
    slides = json.loads((out / "a.gamma.json").read_text())["slides"]
    assert [(s["title"], s["image"]) for s in slides if s["type"] == "image"] == [("Part of it", "a.p1-1.jpeg"), ("Part of it", "a.p2-1.jpeg")]
