"""Decks from Markdown documents (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIGIT, WS, strip
from .deck import THANKS
from .elements import joined

# A phrase whose lines are left out, a notice that forbids copying; more can be given.
SKIPPED: tuple[str, ...] = ("prohibida su reproducción",)
CHUNK = 8


def drop_frontmatter(text: Column) -> Column:
    """Without a leading block between lines of three dashes."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def markdown_lines(docs: DataFrame, toggle: bool = False) -> DataFrame:
    """(doc_id, pos, line), stripped; with ``toggle`` every line of three dashes opens or closes a block that is left out."""
    text = F.col("text") if toggle else drop_frontmatter(F.col("text"))
    # stripped before they are rows: filters on rows would each strip them again
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split(text, "\n", -1), strip)).alias("pos", "line"))
    if toggle:
        dashes = F.count_if(F.col("line") == "---").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        lines = lines.withColumn("n", dashes).where((F.col("n") % 2 == 0) & (F.col("line") != "---")).drop("n")
    return lines


def _skipped(line: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | line.contains(p)
    return out


def markdown_slides(docs: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(doc_id, slide_idx, type, title, part, items): slides of Markdown.

    Numbered headings of level 1 are sections, other headings titles. Items
    without a title wait for the next one. Neighbours with one title become
    one; of neighbouring sections the first stays. Slides show eight items a part.

    Where within its title a slide ends makes no difference, as neighbours of one
    title are joined: an item belongs to the first title from its own line on.
    """
    s = _slides(markdown_lines(docs).withColumn("cover", F.lit(False)), skipped)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "part")) - 1
    return s.select("doc_id", idx.cast("int").alias("slide_idx"), F.when(F.col("section"), "section").otherwise("content").alias("type"), F.when(F.col("section"), F.get("items", F.lit(0))).otherwise(F.col("title")).alias("title"), "part", F.when(~F.col("section"), F.col("items")).alias("items"))


def _slides(lines: DataFrame, skipped) -> DataFrame:
    """(doc_id, run, part, section, title, items) of (doc_id, pos, line, cover); lines of covers come first and are the items of a run 0 without title."""
    line = F.col("line")
    lines = lines.where(F.col("cover") | (line != "") & ~(line.startswith("<!--") & line.contains("Page")) & ~_skipped(line, skipped))
    h1, h = line.startswith("# "), line.rlike(r"\A#{1,4} ")
    head = strip(F.regexp_replace(line, r"\A#+", ""))
    bullet, numbered = line.rlike(r"\A[-*] "), line.rlike(rf"\A{DIGIT}+\. ")
    words = F.split(line, f"{WS}+")
    long = F.when(F.size(words) > 30, F.concat(F.array_join(F.slice(words, 1, 30), " "), F.lit("...")))
    para = ~line.startswith("|") & ~line.startswith("---") & (F.length(line) > 20)
    listed = strip(F.when(bullet, F.substring(line, 3, 2**30)).otherwise(F.regexp_replace(line, rf"\A{DIGIT}+\. ", "")))
    kind = F.when(F.col("cover"), "cover").when(h, F.when(F.length(head) > 3, F.when(h1 & head.rlike(rf"\A{DIGIT}+\."), "section").otherwise("title"))).when(bullet, "bullet").when(numbered, "number").when(para, "para")
    item = F.when(bullet | numbered, F.when(F.length(listed) > 2, listed)).when(para, F.when(F.length(line) < 300, line).otherwise(long))
    e = lines.select("doc_id", "pos", kind.alias("kind"), F.when(h, head).alias("head"), F.when(F.col("cover"), line).when(~h, F.concat(F.lit("- "), item)).alias("item")).where("kind is not null")
    up = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("kind").isin("section", "title")
    e = e.select("*", F.count_if(heads).over(up).alias("seg"), F.last(F.when(heads, F.struct("kind", "head")), ignorenulls=True).over(up).alias("under"))
    goal = F.last(F.when(F.col("under.kind") == "title", F.struct("seg", F.col("under.head").alias("title"))), ignorenulls=True).over(down)
    first = F.col("kind") == "cover"
    e = e.withColumn("goal", F.when(~first, goal)).withColumn("section", F.col("kind") == "section")
    kept = e.where(first | F.col("section") | (F.col("item").isNotNull() & F.col("goal").isNotNull()))
    kept = kept.select("doc_id", "pos", F.when(first, -1).when(F.col("section"), F.col("seg")).otherwise(F.col("goal.seg")).alias("seg"), F.when(F.col("section"), "SECTION").otherwise(F.col("goal.title")).alias("title"), "section", F.when(F.col("section"), F.col("head")).otherwise(F.col("item")).alias("item"))
    order = Window.partitionBy("doc_id").orderBy("seg", "pos")
    new = F.when(F.lag("title").over(order).eqNullSafe(F.col("title")), 0).otherwise(1)
    s = kept.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy("doc_id", "run").agg(F.first("title").alias("title"), F.min_by("section", F.struct("seg", "pos")).alias("section"), F.transform(F.array_sort(F.collect_list(F.struct("seg", "pos", "item"))), lambda x: x["item"]).alias("items"))
    parts = F.when(F.col("run") == 0, F.array("items")).when(F.col("section"), F.array(F.slice("items", 1, 1))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size("items") / CHUNK).cast("int") - 1), lambda k: F.slice(F.col("items"), k * CHUNK + 1, CHUNK)))
    return s.select("doc_id", "run", "title", "section", F.posexplode(parts).alias("part", "items"))


# The line below the brand on the Markdown deck's cover, and what its last line counts.
COVER, MAIN_SLIDES = "Fundamentos de Testing de Software", "slides principales"


def markdown_deck(docs: DataFrame, brand: str, title: Column | None = None, below: str = COVER, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(doc_id, deck, slides): the text of the slides of Markdown, with cover and closing slide.

    ``title`` is an expression over the columns of ``docs``, by default the id.
    Further parts of a slide are marked as continued, and only first parts count.
    A document without slides has cover and closing slide. Covers go along as
    their documents' first lines, so that ``docs`` are made once.
    """
    cover = F.col("doc_id").cast("string") if title is None else title
    text = F.coalesce(F.transform(F.split(drop_frontmatter(F.col("text")), "\n", -1), strip), F.array().cast("array<string>"))
    lines = docs.select("doc_id", F.posexplode(F.concat(F.array(cover), text)).alias("pos", "line"))
    s = _slides(lines.withColumn("cover", F.col("pos") == 0), skipped)
    heading = F.concat(F.lit("## "), "title", F.when(F.col("part") > 0, " (cont.)").otherwise(""), F.lit("\n\n"))
    body = F.concat(heading, F.array_join(F.transform("items", lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("\n---\n\n"))
    t = F.when(F.col("run") == 0, "").when(F.col("section"), F.concat(F.lit("# "), F.get("items", F.lit(0)), F.lit("\n\n---\n\n"))).otherwise(body)
    s = s.select("doc_id", "run", "part", F.when(F.col("run") == 0, F.col("items")).alias("covers"), F.struct("run", "part").alias("k"), t.alias("t"))
    s = s.groupBy("doc_id").agg(joined("t", "k", "").alias("t"), F.count_if((F.col("part") == 0) & (F.col("run") > 0)).alias("n"), F.max("covers").alias("covers"))
    d = s.select("doc_id", F.explode("covers").alias("cover"), "t", "n")
    cover = F.concat(F.lit("# "), "cover", F.lit(f"\n\n**{brand}**\n\n{below}\n\n---\n\n"))
    return d.select("doc_id", F.concat(cover, "t", F.lit(f"# {THANKS}\n\n**{brand}**\n\nTotal: "), F.col("n").cast("string"), F.lit(f" {MAIN_SLIDES}\n")).alias("deck"), F.col("n").alias("slides"))


def section_slides(docs: DataFrame, skipped: tuple[str, ...] = SKIPPED, longest: int = 500) -> DataFrame:
    """(doc_id, slide_idx, section, divider, part, items): items grouped by numbered section, numbered in order of the section's text and part.

    A header that comes again starts its section anew. Sections without items
    are left out; one whose items are all too long has a single part without any.
    """
    lines = markdown_lines(docs, toggle=True)
    line = F.col("line")
    lines = lines.where((line != "") & ~line.contains("<!--") & ~line.startswith("####") & ~_skipped(line, skipped))
    pattern = rf"(?d)\A#+ ({DIGIT}+(?:\.{DIGIT}+)*){WS}+(.+)\z"
    number, name = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    head = F.when(number != "", F.struct("pos", F.concat_ws(" ", number, name).alias("section")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", head).withColumn("of", F.last("head", ignorenulls=True).over(order))
    newest = F.max("of.pos").over(Window.partitionBy("doc_id", "of.section"))
    item = strip(F.regexp_replace(line, r"\A#+", ""))
    kept = lines.withColumn("newest", newest).where(F.col("head").isNull() & F.col("of").isNotNull() & (F.col("of.pos") == F.col("newest")) & (F.length(item) > 3))
    kept = kept.select("doc_id", "pos", F.col("of.section").alias("section"), item.alias("item"))
    s = kept.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    s = s.withColumn("items", F.filter("items", lambda x: F.length(x) < longest))
    n = F.greatest(F.ceil(F.size("items") / CHUNK), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col("items"), k * CHUNK + 1, CHUNK))
    divider = F.col("section").rlike(rf"\A{DIGIT}+\.{DIGIT}+{WS}") & (F.regexp_count("section", F.lit(r"\.")) == 1)
    s = s.select("doc_id", "section", divider.alias("divider"), F.posexplode(parts).alias("part", "items"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "part")) - 1
    return s.select("doc_id", idx.cast("int").alias("slide_idx"), "section", "divider", "part", "items")


def section_deck(docs: DataFrame, title: str, brand: str, **rules) -> DataFrame:
    """(doc_id, deck, slides): the text of the section slides, with cover and closing slide."""
    s = section_slides(docs, **rules)
    first = F.col("part") == 0
    heading = F.concat(F.lit("## "), "section", F.when(first, "").otherwise(" (cont.)"), F.lit("\n\n"))
    body = F.when(F.size("items") > 0, F.concat(F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n---\n\n"))).otherwise("")
    divide = F.when(F.col("divider") & first, F.concat(F.lit("# "), "section", F.lit("\n\n---\n\n"))).otherwise("")
    s = s.select("doc_id", F.struct("section", "part").alias("k"), F.concat(divide, heading, body).alias("t"), ((F.col("divider") & first).cast("int") + (F.size("items") > 0).cast("int")).alias("n"))
    d = s.groupBy("doc_id").agg(joined("t", "k", "").alias("t"), F.sum("n").alias("n"))
    return d.select("doc_id", F.concat(F.lit(f"# {title}\n\n**{brand}**\n\n---\n\n"), "t", F.lit(f"# {THANKS}\n\n**{brand}**\n\n\nTotal: "), F.col("n").cast("string"), F.lit(" slides\n")).alias("deck"), F.col("n").cast("long").alias("slides"))
