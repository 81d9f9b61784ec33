"""Queries over the test tables, one or more for each operator, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deck, docx, elements, language, markdown, metrics, ocr, pages, scripts, tables
from ..sources import pdf
from . import paper, scan

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spans(spark, sf_dir):
    return scan.spans(documents(spark, sf_dir))


# --- SQL building blocks -------------------------------------------------------------------

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"


def _strip(x):
    return rf"regexp_replace(regexp_replace({x}, '\A{_WS}+', ''), '{_WS}+\z', '')"


def _lines(x, rule):
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: {rule}), chr(10))"


_HYPHEN = rf"({_W}+)-{_WS}*\n{_WS}*({_W}+)"


def _clean(x):
    x = rf"regexp_replace({x}, '{_HYPHEN}', '\1\2', 'g')"
    x = rf"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ([.,;:!?])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([.,;:!?])([A-Za-z])', '\1 \2', 'g')"
    x = _lines(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')", _strip("x"))
    for a, b in (("l", "1"), ("O", "0")):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(\A|[^\p{{L}}\p{{N}}_]){a}(\z|[^\p{{L}}\p{{N}}_])', '\1{b}\2', 'g')"
    for a, b in (("l", "1"), ("O", "0")):
        x = rf"regexp_replace({x}, '([0-9]){a}', '\1{b}', 'g')"
    return x


def _normal(x):
    s = _strip("x")
    rule = rf"CASE WHEN regexp_matches({s}, '\A[•●○■□▪▫-]{_WS}+') THEN regexp_replace({s}, '\A[•●○■□▪▫-]{_WS}+', '- ') ELSE regexp_replace({s}, '\A({_D}+)[.)]{_WS}+', '\1. ') END"
    return _lines(x, rule)


_F = scan.DUCK_HEAD + scan.TAIL
_BULLETED, _ENUMERATED, _LETTERED = rf"\A[•●○■□▪▫*-]{_WS}+", rf"\A{_D}+[.)]{_WS}+", rf"\A[A-Za-z][.)]{_WS}+"
_NUMBERED = rf"\A({_D}+(?:\.{_D}+)*){_WS}+(.+)\z"
_UPPER = r"(regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]'))"
#: CTEs from spans to elements.
_ELEMENTS = rf"""
, st AS (SELECT *, {_strip("text")} AS t FROM spans)
, cl AS (SELECT *, regexp_extract(t, '{_NUMBERED}', 1) AS num,
  CASE WHEN regexp_matches(t, '{_BULLETED}') OR regexp_matches(t, '{_ENUMERATED}') OR regexp_matches(t, '{_LETTERED}') THEN 'list_item'
    WHEN font_size >= 16 OR ({_UPPER} AND is_bold AND length(t) > 5) OR (is_bold AND length(t) < 100) THEN 'title'
    WHEN regexp_matches(t, '{_NUMBERED}') THEN 'numbered'
    WHEN (font_size >= 12 AND font_size > 10) OR (is_bold AND length(t) > 5 AND length(t) < 100) THEN 'heading'
    ELSE 'paragraph' END AS kind FROM st WHERE t <> '')
, elements AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, span_no) - 1 AS pos,
  CASE kind WHEN 'numbered' THEN 'heading' ELSE kind END AS type, t AS text,
  CASE kind WHEN 'list_item' THEN 1 WHEN 'title' THEN 1 WHEN 'numbered' THEN least(len(string_split(num, '.')), 6)
    WHEN 'heading' THEN CASE WHEN font_size >= 16 THEN 1 WHEN font_size >= 14 THEN 3 WHEN font_size >= 12 THEN 4 ELSE 5 END END::INT AS level,
  CASE kind WHEN 'numbered' THEN num END AS section_number FROM cl)
"""
_MERGED = _ELEMENTS + """
, starts AS (SELECT *, CASE WHEN type = 'paragraph' AND lag(type) OVER o = 'paragraph' AND lag(page_num) OVER o = page_num THEN 0 ELSE 1 END AS s
  FROM elements WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
, runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM starts)
, merged AS (SELECT doc_id, arg_min(page_num, pos) AS page_num, min(pos) AS pos, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS text, min(level) AS level
  FROM runs GROUP BY doc_id, run)
"""
_REPEATED = rf"""
, own AS (SELECT doc_id, page_num, {_strip("text")} AS t, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0, span_no) AS a,
  row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y0 DESC, span_no DESC) AS z, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM spans WHERE {_strip("text")} <> '')
, ends AS (SELECT doc_id, 'header' AS kind, t FROM own WHERE a = 1 UNION ALL SELECT doc_id, 'footer', t FROM own WHERE z = 1 AND n > 1)
, counted AS (SELECT doc_id, kind, t AS text, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id, kind) AS total FROM ends GROUP BY doc_id, kind, t)
, repeated AS (SELECT doc_id, kind, text FROM counted WHERE c / total >= 0.6 AND doc_id IN (SELECT doc_id FROM spans GROUP BY doc_id HAVING count(DISTINCT page_num) >= 3))
"""


def merged(spark, sf_dir) -> DataFrame:
    return elements.merge_paragraphs(elements.span_elements(spans(spark, sf_dir)))


# --- text ----------------------------------------------------------------------------------


@query(_F + f"SELECT doc_id, page_num, span_no, {_clean('text')} AS text, len(regexp_extract_all(text, '{_HYPHEN}'))::BIGINT AS joins FROM spans")
def clean_text(spark, sf_dir):
    return spans(spark, sf_dir).select("doc_id", "page_num", "span_no", T.clean_text(F.col("text")).alias("text"), T.count_hyphens(F.col("text")).alias("joins"))


@query(_F + f"SELECT doc_id, page_num, span_no, {_normal('text')} AS text FROM spans")
def normalize_lists(spark, sf_dir):
    return spans(spark, sf_dir).select("doc_id", "page_num", "span_no", T.normalize_lists(F.col("text")).alias("text"))


@query(_F + rf"SELECT doc_id, page_num, span_no, {_lines('text', 'CASE WHEN regexp_matches(' + _strip('x') + rf", '\A{_D}+(\.{_D}+)*{_WS}+') THEN " + _strip('x') + ' ELSE x END')} AS text FROM spans")
def preserve_sections(spark, sf_dir):
    return spans(spark, sf_dir).select("doc_id", "page_num", "span_no", T.preserve_sections(F.col("text")).alias("text"))


_PARAS = rf"""
WITH w AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 4 THEN [x, ''] ELSE [x] END)) AS w FROM documents),
l AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS n, unnest(w) AS x FROM w),
b AS (SELECT doc_id, n, {_strip("x")} AS x FROM l),
g AS (SELECT doc_id, n, x, sum(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM b),
p AS (SELECT doc_id, min(n) AS n, string_agg(x, ' ' ORDER BY n) AS x FROM g WHERE x <> '' GROUP BY doc_id, run UNION ALL SELECT doc_id, n, x FROM g WHERE x = '')
SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS text FROM p GROUP BY doc_id"""


@query(_PARAS)
def merge_lines(spark, sf_dir):
    lines = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 5 == 3, F.array(x, F.lit(""))).otherwise(F.array(x))))
    return documents(spark, sf_dir).select("doc_id", T.merge_lines(lines).alias("text"))


@query("""
WITH n AS (SELECT doc_id, translate(text, '<>:"/\\|?*', '_________') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN length(t) > 196 THEN substr(t, 1, 195) ELSE t END AS t FROM n)
SELECT doc_id, CASE WHEN length(t) > 36 THEN substr(t, 1, 35) ELSE t END || '.pdf' AS name, CASE WHEN t = '' THEN '.pdf' ELSE t END || '.gamma.json' AS deck_name FROM s""")
def file_names(spark, sf_dir):
    name = T.clean_filename(F.concat("text", F.lit(".pdf")))
    return documents(spark, sf_dir).select("doc_id", T.clean_filename(name, 40).alias("name"), T.output_name(name, "json").alias("deck_name"))


# --- files ---------------------------------------------------------------------------------


def _paper_pages(spark, sf_dir):
    return pdf.decode_pages(paper.pdfs(documents(spark, sf_dir))).withColumn("doc_id", F.expr("cast(substring_index(path, '.', 1) as long)"))


@query(scan.DUCK_HEAD + f"""
, t AS (SELECT doc_id, line_no // {paper.LINES} AS page_num, line_no, {_strip("line")} AS t FROM lines)
, n AS (SELECT doc_id, max(page_num) + 1 AS n FROM t GROUP BY doc_id)
SELECT doc_id, page_num::INT AS page_num, count(*) FILTER (t <> '') AS spans, coalesce(string_agg(t || chr(10), '' ORDER BY line_no) FILTER (t <> ''), '') AS text, 'Document ' || doc_id AS title, any_value(n)::INT AS page_count,
  595.0::DOUBLE AS width, 842.0::DOUBLE AS height FROM t JOIN n USING (doc_id) GROUP BY doc_id, page_num""")
def pdf_pages(spark, sf_dir):
    p = _paper_pages(spark, sf_dir)
    return p.select("doc_id", "page_num", F.size("spans").cast("long").alias("spans"), pdf.page_text().alias("text"), "metadata.title", "metadata.page_count", "width", "height")


@query(scan.DUCK_HEAD + f"""
SELECT doc_id, (line_no // {paper.LINES})::INT AS page_num, (row_number() OVER (PARTITION BY doc_id, line_no // {paper.LINES} ORDER BY line_no) - 1)::INT AS span_no, t AS text, 40.0::DOUBLE AS x0,
  (34 + 18 * (line_no % {paper.LINES}))::DOUBLE AS y0, 10.0::DOUBLE AS font_size FROM (SELECT doc_id, line_no, {_strip("line")} AS t FROM lines) q WHERE t <> ''""")
def pdf_spans(spark, sf_dir):
    s = pdf.spans(_paper_pages(spark, sf_dir), "doc_id")
    return s.select("doc_id", "page_num", "span_no", "text", "x0", F.round("y0", 6).alias("y0"), "font_size")


# --- elements ------------------------------------------------------------------------------

_OCR = rf"""
, pt AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY span_no) AS text FROM spans GROUP BY doc_id, page_num)
, ol AS (SELECT doc_id, page_num, unnest(range(len(string_split(x, chr(10)))))::INT AS n, unnest(string_split(x, chr(10))) AS t FROM (SELECT doc_id, page_num, {_normal(_clean("text"))} AS x FROM pt) q)
, oc AS (SELECT doc_id, page_num, n, t, regexp_extract(t, '{_NUMBERED}', 1) AS num FROM (SELECT doc_id, page_num, n, {_strip("t")} AS t FROM ol) q WHERE t <> '')
SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, n) - 1 AS pos,
  CASE WHEN num <> '' THEN 'heading' WHEN regexp_matches(t, '{_BULLETED}') OR regexp_matches(t, '{_ENUMERATED}') THEN 'list_item' WHEN {_UPPER} AND length(t) > 5 AND length(t) < 100 THEN 'heading' ELSE 'paragraph' END AS type,
  t AS text, CASE WHEN num <> '' THEN len(string_split(num, '.')) WHEN regexp_matches(t, '{_BULLETED}') OR regexp_matches(t, '{_ENUMERATED}') THEN NULL WHEN {_UPPER} AND length(t) > 5 AND length(t) < 100 THEN 2 END::INT AS level
FROM oc"""


@query(_F + _OCR)
def ocr_line_elements(spark, sf_dir):
    p = spans(spark, sf_dir).groupBy("doc_id", "page_num").agg(elements.joined("text", "span_no", "\n").alias("text"))
    return elements.recognised_elements(p)


@query(_F + _ELEMENTS + "SELECT * FROM elements")
def layout_elements(spark, sf_dir):
    return elements.span_elements(spans(spark, sf_dir)).drop("font_size", "is_bold", "y0")


@query(_F + _MERGED + "SELECT doc_id, page_num, pos, type, text, level FROM merged")
def merged_paragraphs(spark, sf_dir):
    return merged(spark, sf_dir).select("doc_id", "page_num", "pos", "type", "text", "level")


@query(_F + _ELEMENTS + "SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM elements GROUP BY doc_id")
def document_text(spark, sf_dir):
    return elements.document_text(elements.span_elements(spans(spark, sf_dir)))


@query(_F + _MERGED + "SELECT lang, type, count(*) AS n FROM merged JOIN documents USING (doc_id) GROUP BY lang, type")
def element_counts(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang")
    return merged(spark, sf_dir).join(d, "doc_id").groupBy("lang", "type").agg(F.count("*").alias("n"))


# --- pages ---------------------------------------------------------------------------------


@query(_F + f"SELECT doc_id, page_num, round(sum((x1 - x0) * (y1 - y0)) / (595.0 * 842.0), 9)::DOUBLE AS density, (sum((x1 - x0) * (y1 - y0)) / (595.0 * 842.0) < 0.1) AS needs_ocr FROM spans WHERE {_strip('text')} <> '' GROUP BY doc_id, page_num")
def page_density(spark, sf_dir):
    s = spans(spark, sf_dir)
    p = pages.page_density(s, scan.pages(s), threshold=0.1)
    return p.select("doc_id", "page_num", F.round("text_density", 9).alias("density"), "needs_ocr")


@query(_F + _REPEATED + "SELECT * FROM repeated")
def repeated_header_footer(spark, sf_dir):
    s = spans(spark, sf_dir)
    return pages.repeated_texts(s, scan.pages(s))


@query(_F + _REPEATED + f"SELECT doc_id, page_num, span_no, text FROM spans s WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE r.doc_id = s.doc_id AND r.text = {_strip('s.text')})")
def strip_headers(spark, sf_dir):
    s = spans(spark, sf_dir).repartition("doc_id")  # once; pages, texts and the join go by document
    return pages.strip_repeated(s, pages.repeated_texts(s, scan.pages(s))).select("doc_id", "page_num", "span_no", "text")


@query(_F + "SELECT doc_id, page_num, count(*) AS spans FROM spans WHERE page_num IN (0, 2, 3) GROUP BY doc_id, page_num")
def page_filter(spark, sf_dir):
    return pages.choose_pages(spans(spark, sf_dir), T.parse_pages("1,3-4,3")).groupBy("doc_id", "page_num").agg(F.count("*").alias("spans"))


# --- Markdown and decks --------------------------------------------------------------------

_LTRIM = "•●○■□▪▫-*"
_MD = f"""CASE type WHEN 'title' THEN '# ' || text WHEN 'heading' THEN repeat('#', least(coalesce(level, 2), 6)) || ' ' || text
  WHEN 'list_item' THEN repeat('  ', coalesce(level, 1) - 1) || CASE WHEN regexp_matches(text, '\\A\\p{{Nd}}') THEN text ELSE '- ' || ltrim(text, '{_LTRIM} ' || chr(9)) END ELSE text END"""


@query(_F + _MERGED + f""", md AS (SELECT doc_id, pos, page_num, {_MD} AS md, lag(page_num) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM merged)
SELECT doc_id, '---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'languages:' || chr(10) || '  - ' || any_value(lang) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg(CASE WHEN before IS NOT DISTINCT FROM page_num THEN '' ELSE chr(10) || '<!-- Page ' || (page_num + 1) || ' -->' || chr(10) || chr(10) END || md || chr(10) || chr(10), '' ORDER BY pos) AS markdown
FROM md JOIN documents USING (doc_id) GROUP BY doc_id""")
def markdown_document(spark, sf_dir):
    front = documents(spark, sf_dir).select("doc_id", markdown.frontmatter({"title": F.concat(F.lit("Document "), F.col("doc_id").cast("string"))}, {"languages": F.array("lang")}).alias("front"))
    return markdown.markdown(merged(spark, sf_dir), front, page_markers=True)


@query(_F + _MERGED + f", md AS (SELECT doc_id, pos, {_MD} AS md FROM merged) SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY pos) AS markdown FROM md WHERE md <> '' GROUP BY doc_id")
def markdown_text(spark, sf_dir):
    return markdown.elements_text(merged(spark, sf_dir))


@query(_F + _MERGED + """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS n, CASE type WHEN 'title' THEN 'Title' WHEN 'heading' THEN 'Heading' || least(coalesce(level, 1), 9) WHEN 'list_item' THEN 'ListBullet' ELSE '' END AS style,
  CASE type WHEN 'list_item' THEN ltrim(text, '•●○■□▪▫-*0123456789. ' || chr(9)) ELSE text END AS text FROM merged""")
def docx_paragraphs(spark, sf_dir):
    return docx.read_paragraphs(docx.docx(merged(spark, sf_dir)))


_TITLES = """
, ft AS (SELECT doc_id, min(pos) FILTER (type = 'title') AS p FROM merged GROUP BY doc_id)
, titles AS (SELECT m.doc_id, coalesce(arg_min(text, pos) FILTER (type = 'title'), arg_min(text, pos) FILTER (type = 'heading' AND level = 1), 'Untitled Presentation') AS title,
  arg_min(text, pos) FILTER (type = 'heading' AND level <= 2 AND pos > p) AS subtitle FROM merged m JOIN ft USING (doc_id) GROUP BY m.doc_id)
"""


@query(_F + _MERGED + _TITLES + "SELECT * FROM titles")
def deck_title_subtitle(spark, sf_dir):
    return deck.deck_titles(merged(spark, sf_dir))


_SLIDES = f"""
, e AS (SELECT *, count(*) FILTER (type = 'heading') OVER o AS seg, last_value(CASE WHEN type = 'heading' AND level <= 3 THEN {{'level': level, 'text': text}} END IGNORE NULLS) OVER o AS head,
    coalesce(min(CASE WHEN type = 'heading' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4611686018427387904) AS ends
  FROM merged WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, k AS (SELECT *, CASE WHEN type = 'list_item' AND length(ltrim(text, '{_LTRIM}0123456789. ' || chr(9))) > 2 THEN ltrim(text, '{_LTRIM}0123456789. ' || chr(9))
    WHEN type = 'paragraph' AND length(text) > 20 THEN text END AS item, CASE WHEN head.level > 1 THEN head.text END AS slide_title FROM e)
, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, seg, type ORDER BY pos) - 1) // CASE type WHEN 'list_item' THEN 6 ELSE 3 END AS chunk FROM k WHERE item IS NOT NULL AND slide_title IS NOT NULL)
, c AS (SELECT doc_id, seg, type, chunk, any_value(slide_title) AS title, max(pos) AS at_, any_value(ends) AS ends, count(*) AS m, string_agg(item, chr(31) ORDER BY pos) AS items, string_agg(item, chr(10) ORDER BY pos) AS notes FROM n GROUP BY doc_id, seg, type, chunk)
, s AS (
  SELECT doc_id, at_ AS k1, 0 AS k2, 'bullets' AS type, title, NULL AS subtitle, items, NULL AS notes FROM c WHERE m = CASE type WHEN 'list_item' THEN 6 ELSE 3 END
  UNION ALL SELECT doc_id, any_value(ends), 0, 'bullets', any_value(title), NULL, coalesce(max(items) FILTER (type = 'list_item'), max(items) FILTER (type = 'paragraph')),
    CASE WHEN count(*) = 2 THEN max(notes) FILTER (type = 'paragraph') END FROM c WHERE m < CASE type WHEN 'list_item' THEN 6 ELSE 3 END GROUP BY doc_id, seg
  UNION ALL SELECT doc_id, pos, 1, 'section', text, NULL, NULL, NULL FROM merged WHERE type = 'heading' AND level = 1
  UNION ALL SELECT doc_id, -1, 0, 'cover', title, subtitle, NULL, NULL FROM titles)
"""


@query(_F + _MERGED + _TITLES + _SLIDES + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) - 1)::INT AS slide_idx, type, title, subtitle, items, notes FROM s")
def deck_slides(spark, sf_dir):
    s = deck.deck_slides(merged(spark, sf_dir))
    return s.select("doc_id", "slide_idx", "type", "title", "subtitle", F.array_join("items", "\x1f").alias("items"), "notes")


#: Images at two heights of some pages of the scan; between elements they are under the last heading above.
_IMAGES = """SELECT doc_id, page_num, 20e0 * (1 + (doc_id + page_num) % 9) + 5 AS y0, concat('page-', CAST(page_num AS VARCHAR(9)), '-a.png') AS image FROM {spans} WHERE span_no = 0 AND (doc_id + page_num) % 5 = 2
  UNION ALL SELECT doc_id, page_num, 20e0 * (1 + (doc_id + page_num) % 9) + 5, concat('page-', CAST(page_num AS VARCHAR(9)), '-b.png') FROM {spans} WHERE span_no = 0 AND (doc_id + page_num) % 10 = 2
  UNION ALL SELECT doc_id, page_num, 5e0, concat('page-', CAST(page_num AS VARCHAR(9)), '-top.png') FROM {spans} WHERE span_no = 0 AND (doc_id + page_num) % 7 = 0"""
_PLACED = f"""
, im AS ({_IMAGES.format(spans="spans")})
, sy AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, span_no) - 1 AS pos, y0 FROM spans WHERE {_strip("text")} <> '')
, yy AS (SELECT doc_id, page_num, y0, pos, NULL AS image FROM merged JOIN sy USING (doc_id, page_num, pos) UNION ALL SELECT doc_id, page_num, y0, NULL, image FROM im)
, ya AS (SELECT *, coalesce(last_value(pos IGNORE NULLS) OVER w, -1) AS above, count(image) OVER w AS nth FROM yy WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, y0, image NULLS FIRST, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, yh AS (SELECT y.doc_id, y.image, y.above, y.nth, (SELECT arg_max(m.text, m.pos) FROM merged m WHERE m.doc_id = y.doc_id AND m.type = 'heading' AND m.pos <= y.above) AS head FROM ya y WHERE y.image IS NOT NULL)
, si AS (SELECT doc_id, k1, k2, 0 AS k3, type, title, subtitle, items, notes, NULL AS image FROM s UNION ALL SELECT doc_id, above, 2, nth, 'image', coalesce(head, title), NULL, NULL, NULL, image FROM yh JOIN titles USING (doc_id))
"""


@query(_F + _MERGED + _TITLES + _SLIDES + _PLACED + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3) - 1)::INT AS slide_idx, type, title, items, image FROM si")
def deck_images(spark, sf_dir):
    sp = spans(spark, sf_dir)
    m = elements.merge_paragraphs(elements.span_elements(sp))
    images = spark.sql(_IMAGES, spans=sp)
    s = deck.deck_slides(m, images=elements.place_images(images, m))
    return s.select("doc_id", "slide_idx", "type", "title", F.array_join("items", "\x1f").alias("items"), "image")


_Q = lambda x: f"to_json({x})::VARCHAR"
_JSON = f"""
, j AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) AS n, '{{"type":"' || type || '"' || coalesce(',"title":' || {_Q("title")}, '') || coalesce(',"subtitle":' || {_Q("subtitle")}, '')
    || coalesce(',"items":' || {_Q("string_split(items, chr(31))")}, '') || coalesce(',"notes":' || {_Q("notes")}, '') || '}}' AS j FROM s)
, g AS (SELECT doc_id, '[' || string_agg(j, ',' ORDER BY n) || ']' AS slides FROM j GROUP BY doc_id)
, c AS (SELECT doc_id, count(DISTINCT page_num) AS pages FROM merged GROUP BY doc_id)
SELECT doc_id, '{{"brand":{{"name":"Brand","primary":"#000000"}},"title":' || {_Q("title")} || ',"slides":' || slides || coalesce(',"source":' || {_Q("source")}, '')
  || ',"meta":{{"pages":' || pages || ',"lang":[' || coalesce({_Q("lang")}, 'null') || '],"generated_by":"quire","version":"0.1.0"}}}}' AS json
FROM g JOIN c USING (doc_id) JOIN titles USING (doc_id) JOIN documents USING (doc_id)"""


@query(_F + _MERGED + _TITLES + _SLIDES.replace("c AS", "ch AS").replace("FROM c ", "FROM ch ") + _JSON)
def deck_json(spark, sf_dir):
    m = merged(spark, sf_dir)
    info = m.groupBy("doc_id").agg(F.countDistinct("page_num").cast("int").alias("pages")).join(documents(spark, sf_dir).select("doc_id", "source", F.array("lang").alias("languages")), "doc_id")
    brand = F.struct(F.lit("Brand").alias("name"), F.lit("#000000").alias("primary"))
    return deck.deck_json(deck.deck_slides(m), info, brand)


#: The buffer of the text deck, element by element.
_TEXT_SLIDES = f"""
, i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, type, level, text, ltrim(text, '{_LTRIM}0123456789. ' || chr(9)) AS b FROM merged WHERE type <> 'title')
, x AS (SELECT doc_id, n, type = 'heading' AS h, coalesce(level, 0) AS level, text,
    CASE WHEN type = 'list_item' AND length(b) > 2 THEN '- ' || b WHEN type = 'paragraph' AND length(text) > 20 THEN CASE WHEN length(text) < 200 THEN '- ' || text ELSE chr(10) || text || chr(10) END END AS item FROM i)
, a AS (SELECT doc_id, list({{'h': h, 'level': level, 'text': text, 'item': item}} ORDER BY n) AS xs FROM x GROUP BY doc_id)
, fold(doc_id, xs, k, title, held, made) AS (
  SELECT doc_id, xs, 0, NULL::VARCHAR, []::VARCHAR[], []::STRUCT(type VARCHAR, title VARCHAR, items VARCHAR)[] FROM a
  UNION ALL
  SELECT doc_id, xs, k, t, CASE WHEN many THEN held[9:] ELSE held END, made || CASE WHEN many THEN [{{'type': 'content', 'title': t, 'items': array_to_string(held[:8], chr(31))}}] ELSE [] END FROM (
    SELECT doc_id, xs, k, t, held, made, len(held) >= 8 AND t IS NOT NULL AS many FROM (
      SELECT doc_id, xs, k + 1 AS k, CASE WHEN e.h AND e.level = 1 THEN NULL WHEN e.h AND e.level <= 3 THEN e.text ELSE title END AS t,
        (CASE WHEN e.h AND title IS NOT NULL THEN [] ELSE held END) || CASE WHEN e.item IS NULL THEN [] ELSE [e.item] END AS held,
        CASE WHEN e.h AND title IS NOT NULL AND len(held) > 0 THEN [{{'type': 'content', 'title': title, 'items': array_to_string(held, chr(31))}}] ELSE [] END
          || CASE WHEN e.h AND e.level = 1 THEN [{{'type': 'section', 'title': e.text, 'items': ''}}] ELSE [] END AS made
      FROM (SELECT *, xs[k + 1] AS e FROM fold WHERE k < len(xs)) p) q) r)
, ts AS (SELECT doc_id, k, unnest(range(len(made))) AS o, unnest(made) AS s FROM fold
  UNION ALL SELECT doc_id, k + 1, 0, {{'type': 'content', 'title': title, 'items': array_to_string(held, chr(31))}} FROM fold WHERE k = len(xs) AND title IS NOT NULL AND len(held) > 0)
, td AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, o) - 1)::INT AS slide_idx, s.type AS type, s.title AS title, s.items AS items FROM ts)
"""
_RECURSIVE = _F.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_RECURSIVE + _MERGED + _TEXT_SLIDES + "SELECT * FROM td")
def deck_text_slides(spark, sf_dir):
    s = deck.text_deck_slides(merged(spark, sf_dir))
    return s.select("doc_id", "slide_idx", "type", "title", F.array_join("items", "\x1f").alias("items"))


@query(_RECURSIVE + _MERGED + _TITLES + _TEXT_SLIDES + """
, tb AS (SELECT doc_id, count(*) AS n, string_agg(CASE type WHEN 'section' THEN '# ' || title || chr(10) || chr(10) ELSE '## ' || title || chr(10) || chr(10)
    || array_to_string(list_transform(string_split(items, chr(31)), lambda x: x || chr(10)), '') || chr(10) END || '---' || chr(10) || chr(10), '' ORDER BY slide_idx) AS body FROM td GROUP BY doc_id)
SELECT doc_id, '# ' || title || chr(10) || chr(10) || '**Brand**' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '')
  || '# Gracias' || chr(10) || chr(10) || '**Brand**' || chr(10) || chr(10) || 'Total de slides: ' || coalesce(n, 0) || chr(10) AS deck, coalesce(n, 0)::BIGINT AS slides FROM titles LEFT JOIN tb USING (doc_id)""")
def deck_text(spark, sf_dir):
    return deck.text_deck(merged(spark, sf_dir))


def _as_markdown(spark, sf_dir) -> DataFrame:
    return markdown.elements_text(merged(spark, sf_dir)).select("doc_id", F.col("markdown").alias("text"))


_MD_TEXT = f"""
, md AS (SELECT doc_id, pos, {_MD} AS md FROM merged)
, txt AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY pos) AS text FROM md WHERE md <> '' GROUP BY doc_id)
"""
#: Titles, items and sections of Markdown, line by line; the slides' ends inside a title vanish when neighbours are joined.
_MD_SLIDES = rf"""
, ml AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10)))))::INT AS pos, unnest(string_split(t, chr(10))) AS x FROM (SELECT doc_id, regexp_replace(text, '(?s)\A---\n.*?\n---\n', '') AS t FROM txt) q)
, mt AS (SELECT doc_id, pos, x FROM (SELECT doc_id, pos, {_strip("x")} AS x FROM ml) q WHERE x <> '' AND NOT (x LIKE '<!--%' AND x LIKE '%Page%') AND x NOT LIKE '%prohibida su reproducción%')
, mh AS (SELECT *, regexp_matches(x, '\A#{{1,4}} ') AS h, {_strip("regexp_replace(x, '^#+', '')")} AS head, regexp_matches(x, '\A[-*] ') AS bl, regexp_matches(x, '\A{_D}+\. ') AS nb, regexp_split_to_array(x, '{_WS}+') AS w FROM mt)
, mi AS (SELECT *, CASE WHEN bl OR nb THEN {_strip("CASE WHEN bl THEN substr(x, 3) ELSE regexp_replace(x, '^" + _D + "+\\. ', '') END")} END AS li FROM mh)
, mk AS (SELECT doc_id, pos, head, CASE WHEN h THEN CASE WHEN length(head) > 3 THEN CASE WHEN x LIKE '# %' AND regexp_matches(head, '\A{_D}+\.') THEN 'section' ELSE 'title' END END
    WHEN bl OR nb THEN 'item' WHEN x NOT LIKE '|%' AND x NOT LIKE '---%' AND length(x) > 20 THEN 'item' END AS kind,
    '- ' || CASE WHEN bl OR nb THEN CASE WHEN length(li) > 2 THEN li END WHEN length(x) < 300 THEN x WHEN len(w) > 30 THEN array_to_string(w[:30], ' ') || '...' END AS item FROM mi)
, me AS (SELECT *, last_value(CASE WHEN kind <> 'item' THEN {{'k': kind, 't': head, 'p': pos}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM mk WHERE kind IS NOT NULL)
, mg AS (SELECT *, last_value(CASE WHEN u.k = 'title' THEN u END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM me)
, mr AS (SELECT doc_id, CASE kind WHEN 'section' THEN pos ELSE g.p END AS p, pos, kind = 'section' AS sec, CASE kind WHEN 'section' THEN 'SECTION' ELSE g.t END AS title, CASE kind WHEN 'section' THEN head ELSE item END AS item
  FROM mg WHERE kind = 'section' OR (kind = 'item' AND item IS NOT NULL AND g IS NOT NULL))
, ms AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc_id ORDER BY p, pos) IS NOT DISTINCT FROM title THEN 0 ELSE 1 END AS new FROM mr)
, mu AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ms)
, mn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY p, pos) - 1 AS n, first_value(sec) OVER (PARTITION BY doc_id, run ORDER BY p, pos) AS s1 FROM mu)
, mp AS (SELECT doc_id, run, (n // 8)::INT AS part, any_value(s1) AS sec, any_value(title) AS title, arg_min(item, n) AS one, string_agg(item, chr(31) ORDER BY n) AS items FROM mn WHERE NOT s1 OR n = 0 GROUP BY doc_id, run, n // 8)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, part) - 1)::INT AS slide_idx, CASE WHEN sec THEN 'section' ELSE 'content' END AS type, CASE WHEN sec THEN one ELSE title END AS title, part, CASE WHEN NOT sec THEN items END AS items FROM mp"""


@query(_F + _MERGED + _MD_TEXT + _MD_SLIDES.replace("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, part)", ", mx AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, part)", 1) + """)
, mw AS (SELECT doc_id, count(*) FILTER (part = 0) AS n, string_agg(CASE type WHEN 'section' THEN '# ' || title || chr(10) || chr(10) ELSE '## ' || title || CASE WHEN part > 0 THEN ' (cont.)' ELSE '' END || chr(10) || chr(10)
    || array_to_string(list_transform(string_split(items, chr(31)), lambda x: x || chr(10)), '') || chr(10) END || '---' || chr(10) || chr(10), '' ORDER BY slide_idx) AS body FROM mx GROUP BY doc_id)
SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '**Brand**' || chr(10) || chr(10) || 'Fundamentos de Testing de Software' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '')
  || '# Gracias' || chr(10) || chr(10) || '**Brand**' || chr(10) || chr(10) || 'Total: ' || coalesce(n, 0) || ' slides principales' || chr(10) AS deck, coalesce(n, 0)::BIGINT AS slides FROM txt LEFT JOIN mw USING (doc_id)""")
def markdown_deck(spark, sf_dir):
    return scripts.markdown_deck(_as_markdown(spark, sf_dir), "Brand", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))


@query(_F + _MERGED + _MD_TEXT + _MD_SLIDES)
def markdown_to_slides(spark, sf_dir):
    s = scripts.markdown_slides(_as_markdown(spark, sf_dir))
    return s.select("doc_id", "slide_idx", "type", "title", "part", F.array_join("items", "\x1f").alias("items"))


_SECTIONS = _MD_TEXT + rf"""
, ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS x FROM txt)
, lt AS (SELECT doc_id, pos, {_strip("x")} AS x FROM ln)
, lo AS (SELECT *, count(*) FILTER (x = '---') OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM lt)
, hd AS (SELECT doc_id, pos, x, regexp_extract(x, '\A#+ ({_D}+(?:\.{_D}+)*){_WS}+(.+)\z', 1) AS num, regexp_extract(x, '\A#+ ({_D}+(?:\.{_D}+)*){_WS}+(.+)\z', 2) AS name
  FROM lo WHERE d % 2 = 0 AND x <> '---' AND x <> '' AND x NOT LIKE '%<!--%' AND x NOT LIKE '####%' AND x NOT LIKE '%prohibida su reproducción%')
, own AS (SELECT *, last_value(CASE WHEN num <> '' THEN {{'pos': pos, 's': num || ' ' || name}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM hd)
, nw AS (SELECT *, max(h.pos) OVER (PARTITION BY doc_id, h.s) AS newest, {_strip("regexp_replace(x, '^#+', '')")} AS item FROM own)
, kept AS (SELECT doc_id, h.s AS section, item, pos FROM nw WHERE num = '' AND h IS NOT NULL AND h.pos = newest AND length(item) > 3)
, num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS n FROM kept WHERE length(item) < 500)
, gr AS (SELECT doc_id, section, ((n - 1) // 8)::INT AS part, string_agg(item, chr(31) ORDER BY n) AS items FROM num GROUP BY doc_id, section, (n - 1) // 8
  UNION ALL SELECT DISTINCT doc_id, section, 0, '' FROM kept k WHERE NOT EXISTS (SELECT 1 FROM num WHERE num.doc_id = k.doc_id AND num.section = k.section))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1)::INT AS slide_idx, section, (regexp_matches(section, '\A{_D}+\.{_D}+{_WS}') AND len(string_split(section, '.')) = 2) AS divider, part, items FROM gr"""


@query(_F + _MERGED + _SECTIONS)
def section_grouped_deck(spark, sf_dir):
    s = scripts.section_slides(_as_markdown(spark, sf_dir))
    return s.select("doc_id", "slide_idx", "section", "divider", "part", F.array_join("items", "\x1f").alias("items"))


# --- metrics, words, languages, tables -----------------------------------------------------

#: Every third page of the scan counts as recognised.
_PM = _F + f"""
, p AS (SELECT doc_id, page_num, sum((x1 - x0) * (y1 - y0)) / (595.0 * 842.0) AS density, CASE WHEN page_num % 3 = 1 THEN (doc_id % 5 * 20)::DOUBLE END AS conf,
    CASE WHEN page_num % 3 = 1 THEN sum(len(regexp_extract_all(text, '{_HYPHEN}'))) END AS corr FROM spans WHERE {_strip('text')} <> '' GROUP BY doc_id, page_num)
, pm AS (SELECT doc_id, page_num, round(CASE WHEN conf IS NULL THEN density ELSE 1.0 END, 9)::DOUBLE AS native_text_ratio, conf AS ocr_confidence,
    coalesce(last_value(corr IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS words_corrected, 0::BIGINT AS tables_detected FROM p)
"""


def _pages(spark, sf_dir):
    p = pages.counted_pages(spans(spark, sf_dir), scan.WIDTH, scan.HEIGHT)
    read = F.col("page_num") % 3 == 1
    p = p.select("doc_id", "page_num", "text_density", F.when(read, (F.col("doc_id") % 5 * 20).cast("double")).alias("ocr_confidence"), F.when(read, F.col("hyphens")).alias("corrections"))
    return metrics.page_metrics(p).withColumn("native_text_ratio", F.round("native_text_ratio", 9))


@query(_PM + "SELECT * FROM pm")
def page_metrics(spark, sf_dir):
    return _pages(spark, sf_dir)


@query(_PM + "SELECT doc_id, count(*) AS total_pages, count(ocr_confidence) AS pages_ocr, count(*) - count(ocr_confidence) AS pages_native, round(avg(nullif(ocr_confidence, 0.0)), 9)::DOUBLE AS avg_ocr_confidence, sum(words_corrected)::BIGINT AS total_words_corrected, sum(tables_detected)::BIGINT AS total_tables FROM pm GROUP BY doc_id")
def document_metrics(spark, sf_dir):
    return metrics.document_metrics(_pages(spark, sf_dir)).withColumn("avg_ocr_confidence", F.round("avg_ocr_confidence", 9))


@query(_PM + """
, d AS (SELECT doc_id, count(*) AS total_pages, count(ocr_confidence) AS pages_ocr, round(avg(nullif(ocr_confidence, 0.0)), 9)::DOUBLE AS avg_ocr_confidence, sum(words_corrected)::BIGINT AS corrected FROM pm GROUP BY doc_id)
SELECT doc_id, d.total_pages, d.pages_ocr, d.avg_ocr_confidence, pm.page_num, pm.native_text_ratio, pm.words_corrected FROM d JOIN pm USING (doc_id)""")
def metrics_json(spark, sf_dir):
    p = _pages(spark, sf_dir)
    j = metrics.metrics_json(metrics.document_metrics(p), p)
    page = "struct<page_num:int,native_text_ratio:double,words_corrected:bigint>"
    d = j.select("doc_id", F.from_json("json", f"total_pages bigint, pages_ocr bigint, avg_ocr_confidence double, page_metrics array<{page}>").alias("d"))
    d = d.select("doc_id", "d.total_pages", "d.pages_ocr", F.round("d.avg_ocr_confidence", 9).alias("avg_ocr_confidence"), F.explode("d.page_metrics").alias("p"))
    return d.select("doc_id", "total_pages", "pages_ocr", "avg_ocr_confidence", "p.*")


@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x, i: {'t': x, 'c': ((doc_id * 7 + i * 13) % 101)::INT}) AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: trim(x.t, chr(10) || ' ') <> '' AND x.c >= 40) AS w FROM w)
SELECT doc_id, len(w)::BIGINT AS words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: x.c)) / len(w) ELSE 0 END, 9)::DOUBLE AS confidence,
  array_to_string(list_transform(w, lambda x: trim(x.t, chr(10))), ' ') AS text FROM k""")
def ocr_words(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda x, i: F.struct(x.alias("text"), ((F.col("doc_id") * 7 + (i + 1) * 13) % 101).cast("int").alias("confidence")))
    p = ocr.recognised_pages(documents(spark, sf_dir).select("doc_id", F.lit(0).alias("page_num"), words.alias("words")), 40)
    return p.select("doc_id", F.size("words").cast("long").alias("words"), F.round("ocr_confidence", 9).alias("confidence"), "text")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END || '+spa+xx' AS codes FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id, 'spa+xx' FROM documents WHERE lang = 'es'")
def language_codes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.language_list(F.array("lang", F.lit("es"), F.lit("xx"))).alias("codes"))


#: CTEs from documents and a profile to sc: each document's languages, the most probable first.
_GRAMS = r"""
, wd AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM documents)
, gr AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM wd)
"""
_SCORED = rf"""
, wh AS (SELECT doc_id, length(regexp_replace(lower(text), '[^\p{{L}}]+', '', 'g')) AS n, length({_strip("text")}) < {language.SHORTEST} AS short FROM documents)
, ms AS (SELECT doc_id, profile.lang, sum(weight) AS score FROM gr JOIN profile USING (gram) GROUP BY doc_id, profile.lang)
, ex AS (SELECT d.doc_id, l.lang, exp({language.SHARPNESS} * coalesce(score, 0)::DOUBLE / (1000.0::DOUBLE * n)) AS e FROM (SELECT DISTINCT doc_id FROM ms) d CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN ms ON ms.doc_id = d.doc_id AND ms.lang = l.lang JOIN wh ON wh.doc_id = d.doc_id)
, pr AS (SELECT doc_id, lang, round(e / sum(e) OVER (PARTITION BY doc_id), 9) AS prob FROM ex)
, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, lang) AS nth, CASE lang WHEN 'es' THEN 'spa' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'it' THEN 'ita' WHEN 'pt' THEN 'por' WHEN 'ca' THEN 'cat' WHEN 'eu' THEN 'eus' WHEN 'gl' THEN 'glg' ELSE lang END AS code FROM pr)
, sc AS (SELECT doc_id, short, coalesce(string_agg(code, '+' ORDER BY nth) FILTER (nth <= 2 AND prob > 0.1), '') AS found, coalesce(max(prob) FILTER (lang = 'es'), 0) AS es, max(prob) AS top, coalesce(count(lang), 0) AS n FROM wh LEFT JOIN rk USING (doc_id) GROUP BY doc_id, short)
SELECT doc_id, CASE WHEN short OR found = '' THEN 'spa' ELSE found END AS languages, (short OR n = 0 OR es >= 0.5) AS spanish, round(top, 6)::DOUBLE AS prob FROM sc"""
_SEEDS = "WITH profile(gram, lang, weight) AS (VALUES " + ", ".join(f"('{g}', '{lang}', {w})" for g, lang, w in language.seed_weights()) + ")"
_LEARNED = f"""
, gc AS (SELECT lang, gram, count(*) AS n FROM gr WHERE lang IS NOT NULL GROUP BY lang, gram)
, gt AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS nth FROM gc)
, profile AS (SELECT gram, lang, round(1000 * ln(greatest(n / total, {language.FLOOR}) / {language.FLOOR}))::BIGINT AS weight FROM gt WHERE nth <= {language.GRAMS})"""


def _languages(scored: DataFrame) -> DataFrame:
    short, scores = F.col("short"), F.col("scores")
    top = F.round(F.get(scores, F.lit(0))["prob"], 6)
    return scored.select("doc_id", F.array_join(language.languages(short, scores), "+").alias("languages"), language.spanish_dominant(short, scores).alias("spanish"), top.alias("prob"))


@query(_SEEDS + _GRAMS + _SCORED)
def language_id(spark, sf_dir):
    return _languages(language.scored(documents(spark, sf_dir)))


@query(_GRAMS.replace(", wd", "WITH wd", 1) + _LEARNED + _SCORED)
def language_learned(spark, sf_dir):
    d = documents(spark, sf_dir)
    return _languages(language.scored(d, language.learn(d)))


def _tables(spark, sf_dir) -> DataFrame:
    """The lines of each document as a table, of widths that vary, with null cells."""
    d = documents(spark, sf_dir)
    cells = F.transform(F.split("text", "\n", -1), lambda r: F.transform(F.split(r, "[|,;]", -1), lambda c: F.when(F.trim(c) != "", c)))
    return d.select("doc_id", F.lit(0).alias("page_num"), F.lit(0).alias("table_idx"), cells.alias("cells"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.lit("marks").alias("method"))


_CELL = _strip("c")
_TABLE = rf"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: list_transform(regexp_split_to_array(r, '[|,;]'), lambda c: CASE WHEN trim(c) <> '' THEN c END)) AS t FROM documents
  WHERE (doc_id % 10)::DOUBLE / 10 >= 0.5),
n AS (SELECT doc_id, list_filter(t, lambda r: len(list_filter(r, lambda c: c IS NOT NULL)) > 0) AS t FROM t),
u AS (SELECT doc_id, t, list_filter(range(1, coalesce(list_max(list_transform(t, lambda r: len(r))), 0) + 1), lambda j: len(list_filter(t, lambda r: r[j] IS NOT NULL)) > 0) AS u FROM n),
f AS (SELECT doc_id, u, list_transform(t, lambda r: list_transform(u, lambda j: r[j])) AS f FROM u),
p AS (SELECT doc_id, u, f, len(f) > 1 AND len(list_filter(f[1], lambda c: c IS NOT NULL)) > len(u) * 0.5 AS p FROM f),
c AS (SELECT doc_id, CASE WHEN p THEN list_transform(f[1], lambda c: coalesce(c, '')) ELSE list_transform(u, lambda j: (j - 1)::VARCHAR) END AS h,
  list_transform(CASE WHEN p THEN f[2:] ELSE f END, lambda r: list_transform(r, lambda c: coalesce({_CELL}, ''))) AS b FROM p)
SELECT doc_id, array_to_string(h, chr(31)) AS columns, array_to_string(list_transform(b, lambda r: array_to_string(r, chr(31))), chr(30)) AS cells,
  CASE WHEN len(b) > 0 THEN '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(h, lambda x: '---'), '|') || '|' || chr(10)
    || array_to_string(list_transform(b, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) ELSE '' END AS markdown FROM c"""


@query(_TABLE)
def table_clean(spark, sf_dir):
    t = tables.clean_tables(_tables(spark, sf_dir))
    return t.select("doc_id", F.array_join("columns", "\x1f").alias("columns"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "\x1f")), "\x1e").alias("cells"), tables.table_markdown(F.col("columns"), F.col("cells")).alias("markdown"))
