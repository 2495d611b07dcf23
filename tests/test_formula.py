import pytest
from pyspark.sql import functions as F

from phrasemill.functions import formula as FM
from phrasemill.operators.search import formula_score


@pytest.mark.parametrize("expr", [
    "abs(_score - 2)", "acos(0.5)", "asin(0.5)", "atan2(_score, score)", "ceil(_score / 3)", "cos(_score)",
    "exp(_score)", "floor(_score)", "ln(_score)", "log10(_score)", "greatest(_score, score)", "least(_score, 1)",
    "pow(_score, 2)", "sqrt(_score)", "tan(_score)", "cbrt(_score)", "round(_score, 1)", "rand() * 0 + 1",
    "try_divide(_score, score * docMatchCount)", "cast(_score as bigint)", FM.DEFAULT_FORMULA,
])
def test_formula_functions(spark, expr):
    FM.validate(spark, expr)
    df = spark.createDataFrame([(2.5, 0.0, 1, 1.0), (2.5, 2.0, 1, 3.0)], "_score double, score double, docid long, docMatchCount double")
    vals = [r.v for r in df.select(formula_score(expr).alias("v")).collect()]
    assert all(v is not None and v >= 0 for v in vals)


def test_default_formula_score_zero_ranks_first(spark):
    df = spark.createDataFrame([(2.5, 0.0), (2.5, 1.0)], "_score double, score double").withColumn("docid", F.lit(1)) \
        .withColumn("docMatchCount", F.lit(1.0))
    vals = [r.v for r in df.select(formula_score(FM.DEFAULT_FORMULA).alias("v")).collect()]
    assert vals[0] == float("inf") and vals[1] == 2.5


def test_negative_becomes_zero(spark):
    df = spark.createDataFrame([(2.5,)], "_score double")
    assert df.select(formula_score("_score - 10").alias("v")).first().v == 0.0


def test_invalid_formula_fails(spark):
    with pytest.raises(Exception):
        FM.validate(spark, "nosuchfunction(_score)")


def test_haversin(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    km = df.select(FM.haversin(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).first().km
    assert abs(km - 111.19) < 0.1


def test_plain_division_by_zero_raises(spark):
    df = spark.createDataFrame([(2.5, 0.0, 1, 1.0)], "_score double, score double, docid long, docMatchCount double")
    with pytest.raises(Exception):
        df.select(formula_score("_score / score")).collect()


def test_helper_names(spark):
    df = spark.createDataFrame([(2.5, -1.5)], "_score double, score double")
    FM.register(spark)
    for expr, want in (("max(_score, score, 1)", 2.5), ("MIN(_score, 4)", 2.5), ("trunc(_score * 3)", 7.0), ("trunc(score) + 2", 1.0),
                       ("haversin(0, 0, 0, 1)", 111.194927), ("random() * 0 + 1", 1.0)):
        assert abs(df.select(formula_score(expr).alias("v")).first().v - want) < 1e-5, expr
