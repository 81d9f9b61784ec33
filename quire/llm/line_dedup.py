"""Removing repeated runs of lines by winnowing.

Of every window of ``run`` consecutive non-blank lines the smallest line hash is
selected (the rightmost of equal ones), so two equal runs of that many lines
always have a selected line in common, at the same place of the run. About half
of the lines are selected; each keeps the hashes of the ``run - 1`` lines on
either side. With ``words``, shorter windows of at least that many words have
their smallest hash selected as well, so that a passage of one or two long lines
is found too.

Selected lines whose hash is at two positions or more are joined by position:
each with the first position, in order of (id, line), that has the same window
around it. The match is extended to both sides as far as lines are equal, and
the lines of the later position go. Selected lines of a run are at most ``run``
lines apart, so the extensions of its matches meet and a longer run goes whole.

Only DataFrame functions are used. Counts of groups are tables of their own
before they are joined, so that Spark can split a hash with very many positions.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, table, word_count

RUN = 3
#: Words that make a passage of fewer lines than a run.
PASSAGE = 50
_NO_ID = -(2**63)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _selected(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """(id, tag, print, around, windows): the selected lines.

    ``around`` has the line itself and ``run - 1`` lines before and behind it, as
    (at, h, g) or null beyond the text; ``windows`` are the (first, last) places
    in it of the windows that selected the line.
    """
    lines = F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    lines = F.filter(lines, lambda s: ~s["x"].rlike(r"^[\x20\x09-\x0D]*$"))
    fields = lambda s: [s["at"].alias("at"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(s["x"], F.lit(1)).alias("g"), *([] if words is None else [word_count(s["x"]).alias("w")])]
    rows = rows.select("id", "tag", F.transform(lines, lambda s: F.struct(*fields(s))).alias("s")).where(F.size("s") > 0)
    rows = rows.select("id", "tag", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("i"))
    rows = rows.select("id", "tag", *[(F.get("s", F.col("i") + d) if d >= 0 else F.when(F.col("i") + d >= 0, F.get("s", F.col("i") + d))).alias(f"l{run - 1 + d}") for d in range(1 - run, run)])
    at = run - 1
    line = [F.col(f"l{k}") for k in range(2 * run - 1)]
    windows = []
    for size in range(1 if words is not None else run, run + 1):
        for first in range(at - size + 1, at + 1):
            own = range(first, first + size)
            inside = [line[k].isNotNull() for k in own if k != at]
            least = [line[at]["h"] <= line[k]["h"] if k < at else line[at]["h"] < line[k]["h"] for k in own if k != at]
            enough = [] if size == run else [sum((line[k]["w"] for k in own), F.lit(0).cast("long")) >= words]
            windows.append(F.when(_all(inside + least + enough), F.struct(F.lit(first).alias("first"), F.lit(first + size - 1).alias("last"))))
    around = F.array(*[F.when(x.isNotNull(), F.struct(x["at"].alias("at"), x["h"].alias("h"), x["g"].alias("g"))) for x in line])
    rows = rows.select("id", "tag", line[at]["h"].alias("print"), around.alias("around"), F.array_compact(F.array(*windows)).alias("windows"))
    return rows.where(F.size("windows") > 0)


def _equal(ahead: Column, first: Column) -> Column:
    """How many lines of two arrays are equal from the start on; lines beyond a text equal none."""
    pairs = F.zip_with(ahead, first, lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False)))
    stop = F.array_position(pairs, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(pairs)).cast("int")


def repeated_lines(rows: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(id, tag, gone): the numbers of the lines that go, from (id, tag, lines); rows without any don't appear."""
    prints = cut(_selected(rows, run, words))
    often = cut(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    w = prints.join(often, "print", "left_semi").select("id", "tag", "around", F.explode("windows").alias("w"))
    inside = F.slice("around", F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1)
    before, behind = F.reverse(F.slice("around", F.lit(1), F.col("w.first"))), F.slice("around", F.col("w.last") + 2, F.lit(2 * run - 2) - F.col("w.last"))
    w = cut(w.select("id", "tag", inside["at"].alias("covers"), before.alias("before"), behind.alias("behind"), F.xxhash64(inside["h"]).alias("key"), F.xxhash64(inside["g"]).alias("check")))
    place = F.struct("id", "tag", F.col("covers")[0].alias("at"))
    first = w.groupBy("key", "check").agg(F.min(F.struct("id", "tag", F.col("covers")[0].alias("at"), F.col("before").alias("left"), F.col("behind").alias("right"))).alias("first"), F.max(place).alias("last"))
    first = cut(first.where(F.struct("first.id", "first.tag", "first.at") < F.col("last")).drop("last"))
    later = w.join(first, ["key", "check"]).where(place > F.struct("first.id", "first.tag", "first.at"))
    wider = F.concat("covers", F.slice("before", F.lit(1), _equal(F.col("before"), F.col("first.left")))["at"], F.slice("behind", F.lit(1), _equal(F.col("behind"), F.col("first.right")))["at"])
    gone = later.select("id", "tag", F.explode(wider).alias("line"))
    return gone.groupBy("id", "tag").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, n_lines: str | None = None, n_removed: str | None = None, words: int | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated runs of ``run`` lines or more cut from the text, and with ``words`` those of fewer lines and at least so many words.

    Lines end at newlines; blank ones are no part of a run and stay. Null texts
    stay null, and texts of fewer than ``run`` non-blank lines stay as they
    are without ``words``; a text whose every line goes becomes empty, and its row stays. A null
    id comes before all others. Rows with one id and one text are one document:
    they lose the same lines; rows with one id and different texts are told
    apart by a hash of the text. An ``n_chars`` column is set to the new length,
    other columns are kept. ``n_lines`` and ``n_removed`` name columns to add.
    Texts of any length are read as wholes, in parts of a line; no rows give no rows.
    """
    free = (x for x in (f"_quire_{k}" for k in count()) if x not in docs.columns)
    own = {c: next(free) for c in ("id", "tag", "gone")}
    rows = docs.withColumn(own["id"], F.coalesce(F.col(id_col), F.lit(_NO_ID)))
    rows = rows.withColumn(own["tag"], F.xxhash64(text_col))
    lines = F.split(F.col(text_col), "\n", -1)
    gone = repeated_lines(docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("tag"), lines.alias("lines")), run, words)
    gone = gone.select(F.col("id").alias(own["id"]), F.col("tag").alias(own["tag"]), F.col("gone").alias(own["gone"]))
    rows = rows.join(gone, [own["id"], own["tag"]], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own["gone"]))
    text = F.when(F.col(own["gone"]).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    changed = F.col(own["gone"]).isNotNull()
    total, removed = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)), F.coalesce(F.size(F.when(changed, F.col(own["gone"]))), F.lit(0))
    added = [x.cast("long").alias(n) for x, n in ((total, n_lines), (removed, n_removed)) if n]
    rows = rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], changed.alias(own["id"]), *added)
    if "n_chars" in docs.columns:  # a step of its own: the text must be made once
        rows = rows.withColumn("n_chars", F.when(F.col(own["id"]), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.drop(own["id"])


def op9_winnowed_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, n_lines="n_lines", n_removed="n_removed", words=PASSAGE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ln, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, ln, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS n FROM l WHERE NOT regexp_matches(x, '^[\x20\x09-\x0D]*$')),
v AS (SELECT doc_id, ln, x, m, lead(x) OVER d AS x2, lead(m) OVER d AS m2, lead(ln) OVER d AS ln2, lead(x, 2) OVER d AS x3, lead(ln, 2) OVER d AS ln3 FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
w AS (
  SELECT doc_id, ln, x || chr(10) || x2 || chr(10) || x3 AS s, [ln, ln2, ln3] AS covers FROM v WHERE x3 IS NOT NULL
  UNION ALL SELECT doc_id, ln, x || chr(10) || x2, [ln, ln2] FROM v WHERE x2 IS NOT NULL AND m + m2 >= {PASSAGE}
  UNION ALL SELECT doc_id, ln, x, [ln] FROM v WHERE m >= {PASSAGE}),
f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, ln) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(covers) AS ln FROM f WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n, count(gone.ln) AS g, string_agg(CASE WHEN gone.ln IS NULL THEN x END, chr(10) ORDER BY l.ln) AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.ln = gone.ln GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
