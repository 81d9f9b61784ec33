"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: a share by weight of all words, at most
``cap`` times what the source has, the excess reshared by weight.

Inside a source longer documents are wanted more often: a document of ``size``
words has the measure of its length in binary digits, and its expected number of
copies is ``least(cap, level * measure)``, with the level at which the expected
words of all documents are the target. The whole part of that number is certain
copies; the rest is the inclusion probability of one more. Documents are ranked
by the odds of a uniform number (a digest of the id, so reruns agree) over
their inclusion odds, and a sample of fixed size, in words, is taken from the
front of the ranking.

The measures of a source are at most 64 classes, so the level is found from a
table of sums. The cut in the ranking is found without sorting a source: word
sums over bins of the rank show the bin where the target is met, sums over its
sub-bins narrow it, and only the rows of that sub-bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions, table, word_count

BINS = 4096
#: Inclusion probabilities nearer to 0 or 1 than this are rounding.
NIL = 1e-12


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 from the id, or for a null id from the text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def measure(size: Column) -> Column:
    """Binary digits of a size; 0 for an empty document."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def _numbered(s: DataFrame) -> DataFrame:
    """Adds ``nth``, the place of each source in order, null last, without bringing them to one task."""
    own = cut(s.repartitionByRange(partitions(s.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, at = {}, 0
    for r in own.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each task
        before[r.part], at = at, at + r.n
    if not before:
        return own.withColumn("nth", F.lit(0).cast("long")).drop("part")
    start = F.create_map(*[F.lit(v) for p in before.items() for v in p])[F.col("part")]
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return own.withColumn("nth", (start + nth - 1).cast("long")).drop("part")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, weigh ``weights``, repeating. Targets
    are ``least(cap * size, weight * share)``: each round shares what the capped
    sources leave among the others, and caps those that get more than they may.
    The share rises from round to round, so the rounds end.
    """
    s = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    s = cut(s.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).drop("nth"))
    full_at = F.col("most").cast("double") / F.col("weight").cast("double")
    share = capped = None
    while True:
        over = F.lit(False) if share is None else full_at < share
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("most"))).alias("most"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if r.n == capped or not r.weight:
            break
        capped, share = r.n, float(r.all - (r.most or 0)) / float(r.weight)
    return s.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(share or 0.0)).alias("target"))


def _expected(sized: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, target, goal, level): ``level`` copies for each unit of measure, ``goal`` the words beyond whole copies.

    Classes of a large measure reach ``cap`` first. With those of measures above
    m at the cap, the level is what is left of the target over the measured words
    of the others; the first that leaves class m at the cap or below holds.
    """
    c = sized.where("size > 0").groupBy("source", "m").agg(F.sum("size").alias("words"))
    above = Window.partitionBy("source").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("m")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.select("source", "m", "words", F.coalesce(F.sum("words").over(above), F.lit(0)).alias("full"), F.sum(F.col("m") * F.col("words")).over(rest).alias("measured"))
    s = sources.select(F.col("source").alias("of"), "source_size", "target")
    c = c.join(s, F.col("source").eqNullSafe(F.col("of")))
    level = (F.col("target") - (cap * F.col("full")).cast("double")) / F.col("measured").cast("double")
    c = c.withColumn("level", level)
    fits = F.max(F.when(F.col("level") * F.col("m") <= cap, F.struct("m", "level")))
    levels = c.groupBy("source").agg(F.coalesce(fits["level"], F.lit(float(cap))).alias("level"))
    whole = F.floor(F.least(F.lit(float(cap)), F.col("level") * F.col("m")) + NIL)
    c = c.drop("level").join(levels.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
    goals = c.groupBy("source").agg(F.max("level").alias("level"), F.sum(whole * F.col("words")).cast("long").alias("certain"))
    out = s.join(goals, F.col("of").eqNullSafe(F.col("source")), "left")
    return out.select(F.col("of").alias("source"), "source_size", "target", (F.col("target") - F.coalesce("certain", F.lit(0)).cast("double")).alias("goal"), F.coalesce("level", F.lit(0.0)).alias("level"))


def _narrow(rows: DataFrame, sources: DataFrame, bin_: Column, name: str) -> DataFrame:
    """Adds to ``sources`` the bin where the running sum passes ``goal``, and the sum before it."""
    sums = rows.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    s = sources.withColumnRenamed("source", "of")
    met = sums.join(s, F.col("source").eqNullSafe(F.col("of"))).where(F.col("base") + F.col("before") < F.col("goal"))
    met = met.groupBy("source").agg(F.max(F.struct("bin", "before")).alias("met"))
    out = s.join(met, F.col("of").eqNullSafe(F.col("source")), "left")
    return out.select(*[F.col(c) for c in s.columns if c not in ("of", "base")], F.col("of").alias("source"), F.coalesce("met.bin", F.lit(-1)).alias(name), (F.col("base") + F.coalesce("met.before", F.lit(0))).alias("base"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for every row of ``docs``.

    Null texts have size 0; a null source is a source of its own, a null id
    draws by its text. Rows with one id draw the same number; ties in the
    ranking go by id and size, and equal rows are told apart by nothing, so any
    of them may be the one that the cut takes. Documents of size 0 get no copies.
    A source without words has target 0. No rows give no rows; further columns
    are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _uniform(F.col(id_col), F.col(text_col)).alias("u"))
    sized = cut(sized.withColumn("m", measure(F.col("size"))))
    s = _expected(sized, cut(source_targets(sized, weights, cap)), cap)
    s = cut(s.withColumn("base", F.lit(0).cast("long")))

    def ranked(sources: DataFrame) -> DataFrame:
        d = sized.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        copies = F.least(F.lit(float(cap)), F.col("level") * F.col("m"))
        d = d.withColumn("whole", F.floor(copies + NIL).cast("long")).withColumn("p", copies - F.col("whole"))
        d = d.withColumn("q", F.when(F.col("p") > NIL, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        scaled = F.col("q") / (1 + F.col("q")) * BINS
        return d.withColumn("coarse", F.floor(scaled)).withColumn("fine", F.floor((scaled - F.floor(scaled)) * BINS))

    s1 = cut(_narrow(ranked(s).where("q is not null"), s, F.col("coarse"), "at"))
    s2 = cut(_narrow(ranked(s1).where("coarse = at"), s1, F.col("fine"), "fine_at"))
    d = ranked(s2)
    edge = (F.col("coarse") == F.col("at")) & (F.col("fine") == F.col("fine_at"))
    d = d.withColumn("edge", F.coalesce(edge, F.lit(False)))
    sure = F.coalesce((F.col("coarse") < F.col("at")) | ((F.col("coarse") == F.col("at")) & (F.col("fine") < F.col("fine_at"))), F.lit(False))
    run = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0))
    out = ["doc_id", "source", "size", "source_size", "target"]
    rest = d.where("not edge").select(*out, (F.col("whole") + sure.cast("long")).alias("copies"))
    close = d.where("edge").withColumn("before", before).select(*out, (F.col("whole") + (2 * F.col("before") + F.col("size") < 2 * F.col("goal")).cast("long")).alias("copies"))
    return rest.unionByName(close)


def op7_pareto_mixing(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Sorts each source as a whole, which a single machine can.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
z AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS m FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS most, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM src),
l AS (
  SELECT *, row_number() OVER o AS nth, most::DOUBLE / weight::DOUBLE AS full_at,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS LAST)),
lv AS (SELECT arg_min(level, nth) AS level FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, least(most::DOUBLE, weight::DOUBLE * coalesce((SELECT level FROM lv), 0.0::DOUBLE)) AS target FROM l),
c AS (SELECT source, m, sum(size)::BIGINT AS words FROM z WHERE size > 0 GROUP BY source, m),
a AS (
  SELECT c.source, c.m, c.words, target, (target - (3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
      / (sum(c.m * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY c.m DESC)),
v AS (SELECT source, coalesce(arg_max(level, m) FILTER (level * m::DOUBLE <= 3), 3.0::DOUBLE) AS level FROM a GROUP BY source),
e AS (SELECT a.source, sum(floor(least(3.0::DOUBLE, v.level * m::DOUBLE) + 1e-12) * words)::BIGINT AS certain FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source GROUP BY a.source),
n AS (
  SELECT doc_id, size, u, z.source, t.source_size, target, target - coalesce(certain, 0)::DOUBLE AS goal, least(3.0::DOUBLE, coalesce(v.level, 0) * m::DOUBLE) AS copies
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN v ON z.source IS NOT DISTINCT FROM v.source LEFT JOIN e ON z.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, floor(copies + 1e-12)::BIGINT AS whole, copies - floor(copies + 1e-12) AS p FROM n),
q AS (SELECT *, CASE WHEN p > 1e-12 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
r AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM q)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN q IS NOT NULL AND 2 * before + size < 2 * goal THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
