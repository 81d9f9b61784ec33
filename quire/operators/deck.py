"""Slide decks of a document's merged elements (doc_id, pos, type, text, level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, strip_bullet

BULLETS_PER_SLIDE, PARAGRAPHS_PER_SLIDE, ITEMS_PER_SLIDE = 6, 3, 8
_END = 2**62
# Words of decks.
UNTITLED, TABLE, THANKS, TOTAL = "Untitled Presentation", "Tabla", "Gracias", "Total de slides"


def bullet(kind: Column, text: Column) -> Column:
    """What a list item or paragraph adds to a slide; null if it is too short."""
    item, para = strip_bullet(text), strip(text)
    return F.when((kind == "list_item") & (F.length(item) > 2), item).when((kind == "paragraph") & (F.length(para) > 20), para)


def deck_titles(elements: DataFrame, untitled: str = UNTITLED) -> DataFrame:
    """(doc_id, title, subtitle): the first title, else the first heading of level 1; the first heading of level 1 or 2 after the first title."""
    first = F.min(F.when(F.col("type") == "title", F.col("pos"))).over(Window.partitionBy("doc_id"))
    e = elements.withColumn("first_title", first)
    heading = F.col("type") == "heading"
    pick = lambda cond: F.min_by(F.when(cond, F.col("text")), F.when(cond, F.col("pos")))
    title = F.coalesce(pick(F.col("type") == "title"), pick(heading & (F.col("level") == 1)), F.lit(untitled))
    return e.groupBy("doc_id").agg(title.alias("title"), pick(heading & (F.col("level") <= 2) & (F.col("pos") > F.col("first_title"))).alias("subtitle"))


def deck_slides(elements: DataFrame, tables: DataFrame | None = None, logo: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, slide_idx, type, title, subtitle, items, notes, md, logo, image): cover, then slides in order, then tables.

    A heading of level 1 makes a section and ends the title; levels 2 and 3 set
    the title; any heading ends a slide. Bullets fill slides of six, paragraphs
    slides of three; what a segment leaves over is one slide, its paragraphs as
    notes of its bullets. Items under no title are dropped. ``images`` (doc_id,
    pos, nth, image) have a slide each, behind the element at ``pos``, titled as
    the last heading up to it, else as the deck. One pass over each document's
    elements, which are brought together once.
    """
    doc = Window.partitionBy("doc_id")
    running = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading, title, at1 = F.col("type") == "heading", F.col("type") == "title", F.col("level") == 1
    e = elements.select("doc_id", "pos", "type", "level", "text", bullet(F.col("type"), F.col("text")).alias("item"))
    head = F.last(F.when(heading & (F.col("level") <= 3), F.struct("level", "text")), ignorenulls=True).over(running)
    e = e.select("*", F.count_if(heading).over(running).alias("seg"), head.alias("head"), F.row_number().over(doc.orderBy("pos")).alias("nth_element"))
    pick = lambda cond: F.min_by(F.when(cond, F.col("text")), F.when(cond, F.col("pos"))).over(doc)
    e = e.withColumn("first_title", F.min(F.when(title, F.col("pos"))).over(doc))
    e = e.withColumns({"cover_title": F.coalesce(pick(title), pick(heading & at1), F.lit(UNTITLED)), "cover_subtitle": pick(heading & (F.col("level") <= 2) & (F.col("pos") > F.col("first_title")))})
    kept = F.col("item").isNotNull() & (F.col("head.level") > 1)
    kind = Window.partitionBy("doc_id", "seg", "type")
    e = e.withColumns({"nth": F.count_if(kept).over(kind.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), "of": F.count_if(kept).over(kind)})
    size = F.when(F.col("type") == "list_item", BULLETS_PER_SLIDE).otherwise(PARAGRAPHS_PER_SLIDE)
    chunk = F.floor((F.col("nth") - 1) / size)
    full = chunk < F.floor(F.col("of") / size)
    null = F.lit(None).cast("string")

    def row(when, seg, at, kind_, title_, subtitle, item):
        # a slide is where its last element is; what is left over comes last
        return F.when(when, F.struct(seg.cast("long").alias("seg"), at.cast("long").alias("chunk"), kind_.alias("type"), title_.alias("title"), subtitle.alias("subtitle"), item.alias("item")))

    cover = row(F.col("nth_element") == 1, F.lit(-1), F.lit(0), F.lit("cover"), F.col("cover_title"), F.col("cover_subtitle"), null)
    section = row(heading & at1, F.col("seg"), F.lit(-1), F.lit("section"), F.col("text"), null, null)
    content = row(kept, F.col("seg"), F.when(full, chunk * 2 + (F.col("type") == "paragraph").cast("int")).otherwise(_END), F.lit("bullets"), F.col("head.text"), null, F.col("item"))
    rows = e.select("doc_id", "pos", F.col("type").alias("element"), F.explode(F.array_compact(F.array(cover, section, content))).alias("s")).select("doc_id", "pos", "element", "s.*")
    own = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("element") == t, F.struct("pos", "item")))), lambda x: x["item"])
    s = rows.groupBy("doc_id", "seg", "chunk", "type").agg(F.first("title").alias("title"), F.first("subtitle").alias("subtitle"), F.max("pos").alias("at"), own("list_item").alias("b"), own("paragraph").alias("p"))
    bullets, both = F.col("type") == "bullets", (F.size("b") > 0) & (F.size("p") > 0)
    s = s.select("doc_id", "seg", F.when(F.col("chunk") == _END, _END).when(bullets, F.col("at")).otherwise(F.col("chunk")).alias("at"), "type", "title", "subtitle", F.when(bullets, F.when(F.size("b") > 0, F.col("b")).otherwise(F.col("p"))).alias("items"), F.when(bullets & both, F.array_join("p", "\n")).alias("notes"), null.alias("md"), null.alias("image"), F.lit(0).cast("long").alias("nth"))
    none = F.lit(None).cast("array<string>")
    if tables is not None:
        t = tables.select("doc_id", F.lit(_END).alias("seg"), F.col("table_idx").cast("long").alias("at"), F.lit("table").alias("type"), F.concat(F.lit(f"{TABLE} "), (F.col("table_idx") + 1).cast("string")).alias("title"), null.alias("subtitle"), none.alias("items"), null.alias("notes"), "md", null.alias("image"), F.lit(0).cast("long").alias("nth"))
        s = s.unionByName(t)
    if images is not None:
        own = e.select("doc_id", "pos", F.lit(0).cast("long").alias("nth"), null.alias("image"), F.col("seg").cast("long").alias("seg"), F.when(heading, F.col("text")).alias("head"), "cover_title")
        among = doc.orderBy("pos", "nth").rowsBetween(Window.unboundedPreceding, 0)
        i = own.unionByName(images.select("doc_id", "pos", "nth", "image"), allowMissingColumns=True)
        last = lambda c: F.last(c, ignorenulls=True).over(among)
        i = i.select("doc_id", F.coalesce(last("seg"), F.lit(0).cast("long")).alias("seg"), F.col("pos").alias("at"), F.lit("image").alias("type"), F.coalesce(last("head"), F.max("cover_title").over(doc)).alias("title"), null.alias("subtitle"), none.alias("items"), null.alias("notes"), null.alias("md"), "image", "nth")
        s = s.unionByName(i.where("image is not null and title is not null"))  # a document without elements has no deck
    idx = F.row_number().over(doc.orderBy("seg", "at", "nth")) - 1
    return s.select("doc_id", idx.cast("int").alias("slide_idx"), "type", "title", "subtitle", "items", "notes", "md", F.when(F.col("type") == "cover", F.lit(logo)).cast("string").alias("logo"), "image")


def deck_json(slides: DataFrame, info: DataFrame, brand: Column) -> DataFrame:
    """(doc_id, json): the deck without null fields, titled as its cover, from slides and (doc_id, source, pages, languages)."""
    slide = F.struct("slide_idx", "type", "title", "subtitle", "items", "md", "image", "notes", "logo")
    title = F.max(F.when(F.col("type") == "cover", F.col("title")))
    s = slides.groupBy("doc_id").agg(F.array_sort(F.collect_list(slide)).alias("slides"), title.alias("title"))
    s = s.withColumn("slides", F.transform("slides", lambda x: x.dropFields("slide_idx")))
    meta = F.struct(F.col("pages"), F.col("languages").alias("lang"), F.lit("quire").alias("generated_by"), F.lit("0.1.0").alias("version"))
    return s.join(info, "doc_id").select("doc_id", F.to_json(F.struct(brand.alias("brand"), "title", "slides", "source", meta.alias("meta"))).alias("json"))


def text_deck_slides(elements: DataFrame) -> DataFrame:
    """(doc_id, slide_idx, type, title, items) of the text deck, without cover, tables and closing slide.

    One buffer holds bullets and paragraphs. A heading writes it under the
    current title, and so does an element that brings it to eight items, eight
    at a time; what has no title waits for the next one.

    So an item belongs to the first segment from its own on that has a title,
    and every element of that segment, its heading included, writes eight items
    if there are so many: of n items and m elements ``least(m, n // 8)`` slides of
    eight, and one of the rest.
    """
    doc = Window.partitionBy("doc_id")
    up = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = doc.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    text, heading = F.col("text"), F.col("type") == "heading"
    para = strip(text)
    item = F.when((F.col("type") == "list_item") & (F.length(strip_bullet(text)) > 2), F.concat(F.lit("- "), strip_bullet(text))).when(
        (F.col("type") == "paragraph") & (F.length(para) > 20), F.when(F.length(para) < 200, F.concat(F.lit("- "), para)).otherwise(F.concat(F.lit("\n"), para, F.lit("\n")))
    )
    e = elements.where("type <> 'title'").select("doc_id", "pos", "type", "level", "text", item.alias("item"))
    head = F.last(F.when(heading & (F.col("level") <= 3), F.struct("level", "text")), ignorenulls=True).over(up)
    e = e.select("*", F.count_if(heading).over(up).alias("seg"), head.alias("head"))
    goal = F.last(F.when(F.col("head.level") > 1, F.struct("seg", F.col("head.text").alias("title"))), ignorenulls=True).over(down)
    e = e.withColumn("goal", goal).withColumn("to", F.col("goal.seg"))
    held, steps = F.col("item").isNotNull(), F.count_if(F.col("seg") == F.col("to"))
    by = Window.partitionBy("doc_id", "to")
    e = e.select("*", F.count_if(held).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("nth"), F.count_if(held).over(by).alias("n"), steps.over(by).alias("steps"))
    chunk = F.least(F.floor((F.col("nth") - 1) / ITEMS_PER_SLIDE), F.floor(F.col("n") / ITEMS_PER_SLIDE), F.col("steps"))
    section = heading & (F.col("level") == 1)
    kept = e.where(section | (held & F.col("to").isNotNull()))
    kept = kept.select("doc_id", "pos", F.when(section, F.col("seg")).otherwise(F.col("to")).alias("seg"), F.when(section, -1).otherwise(chunk).alias("chunk"), F.when(section, "section").otherwise("content").alias("type"), F.when(section, text).otherwise(F.col("goal.title")).alias("title"), "item")
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "content", F.struct("pos", "item")))), lambda x: x["item"])
    s = kept.groupBy("doc_id", "seg", "chunk", "type").agg(F.first("title").alias("title"), items.alias("items"))
    idx = F.row_number().over(doc.orderBy("seg", "chunk")) - 1
    return s.select("doc_id", idx.cast("int").alias("slide_idx"), "type", "title", "items")


def text_deck(elements: DataFrame, brand_name: str = "Brand", tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, deck, slides): the text deck with cover, tables and closing slide, and how many slides it counts."""
    s = text_deck_slides(elements)
    content = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.array_join(F.transform("items", lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("\n---\n\n"))
    s = s.withColumn("t", F.when(F.col("type") == "section", F.concat(F.lit("# "), "title", F.lit("\n\n---\n\n"))).otherwise(content))
    body = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_idx", "t"))), lambda x: x["t"]), "").alias("body"), F.count("*").alias("n"))
    d = deck_titles(elements).join(body, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("body", F.coalesce("body", F.lit("")))
    if tables is not None:
        one = F.concat(F.lit(f"## {TABLE} "), (F.col("table_idx") + 1).cast("string"), F.lit("\n\n"), "md", F.lit("\n\n---\n\n"))
        t = tables.withColumn("t", one).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "t"))), lambda x: x["t"]), "").alias("tt"), F.count("*").alias("tn"))
        d = d.join(t, "doc_id", "left").withColumn("body", F.concat("body", F.coalesce("tt", F.lit("")))).withColumn("n", F.col("n") + F.coalesce("tn", F.lit(0)))
    cover = F.concat(F.lit("# "), "title", F.lit(f"\n\n**{brand_name}**\n\n---\n\n"))
    close = F.concat(F.lit(f"# {THANKS}\n\n**{brand_name}**\n\n{TOTAL}: "), F.col("n").cast("string"), F.lit("\n"))
    return d.select("doc_id", F.concat(cover, "body", close).alias("deck"), F.col("n").cast("long").alias("slides"))
