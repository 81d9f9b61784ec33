"""The rules as SQL functions: equal to the Column functions, and inlined."""

from pyspark.sql import functions as F

from quire.functions import sql
from quire.plans.catalog import QUERIES
from tests.conftest import SF

TEXTS = ["a  b , c .d", "ex-\nample  l O 2l 3O", "• one\n1) two\n - x", "1.2 Part\n 3 x ", "", None, " \n\n\n\n ", "it's 'quoted' \\ back", "UPPER ÉÑ", "a) x", "2.3.4 Words here", "dir/na<me>.tar.gz"]


def test_functions_equal_the_rules(spark):
    assert len(sql.register(spark)) == len(sql.RULES)
    d = spark.createDataFrame([(i, t, float(i + 8), i % 2 == 0) for i, t in enumerate(TEXTS)], "i int, text string, size double, bold boolean")
    d = d.withColumns({"lines": F.split("text", "\n"), "columns": F.array(F.lit("a'b"), F.lit("c"), F.lit("a'b")), "cells": F.array(F.array("text", F.lit("x"), F.lit("y")), F.array(F.lit("z"), F.lit("|"), "text"))})
    d = d.withColumns({"name": F.col("text"), "path": F.col("text"), "code": F.lit("en"), "codes": F.array(F.lit("en"), F.lit("es"), F.lit("en"), F.lit("xx"))})
    d.createOrReplaceTempView("texts_of_test")
    for name, (parameters, _, rule) in sql.RULES.items():
        names = [p.split()[0] for p in parameters.replace("ARRAY<ARRAY<STRING>>", "A").split(", ")]
        got = [r.x for r in spark.sql(f"SELECT i, {sql.PREFIX}{name}({', '.join(names)}) AS x FROM texts_of_test ORDER BY i").collect()]
        want = [r.x for r in d.select("i", rule(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()]
        assert got == want, name


def test_functions_are_inlined(spark):
    for name in ("sql_clean_text", "sql_layout_elements"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "quire_" not in plan and "regexp_replace" in plan


def test_sql_equals_dataframes(spark):
    for name, same in (("sql_clean_text", "clean_text"), ("sql_layout_elements", "layout_elements")):
        a, b = QUERIES[name](spark, SF), QUERIES[same](spark, SF)
        assert a.schema.simpleString() == b.select(*a.columns).schema.simpleString() and a.exceptAll(b.select(*a.columns)).isEmpty() and a.count() == b.count()
