"""Scoring-formula helpers (QRY-5, UDF-2).

A formula is a Spark SQL expression over the columns ``_score`` (relevance),
``score`` (document score), ``docid`` and ``docMatchCount`` (1 + earlier
results of the source).  Spark SQL's own functions are available: abs acos
acosh asin asinh atan atan2 atanh cbrt ceil cos cosh exp floor ln log10 pow
round sin sinh sqrt tan tanh.  Besides: ``max``/``min`` of values,
``trunc(x)``, ``random()`` and ``haversin(lat1, lon1, lat2, lon2)``.  Division
by zero raises under ANSI mode: use ``try_divide`` (the default formula does).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Relevance divided by the document score; a score of 0 ranks first.
DEFAULT_FORMULA = "coalesce(try_divide(_score, score), double('Infinity'))"
EARTH_RADIUS_KM = 6371.0

# Names that mean something else, or nothing, in Spark SQL; the last two are
# SQL functions of the session (``register``).
_NAMES = {"max": "greatest", "min": "least", "random": "rand", "trunc": "pm_trunc", "haversin": "pm_haversin"}
_CALL = re.compile(r"(?<![\w.'\"`])(" + "|".join(_NAMES) + r")(?=\s*\()", re.IGNORECASE)
_FUNCTIONS = [
    "pm_trunc(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x < 0 THEN -floor(-x) ELSE floor(x) END",
    "pm_haversin(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
    f"{2 * EARTH_RADIUS_KM} * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) "
    "+ cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))",
]


def register(spark: SparkSession) -> None:
    """Define the helper functions in the session (SQL functions, inlined by the analyser)."""
    for f in _FUNCTIONS:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + f)


def sql_formula(formula: str) -> str:
    """The formula with its function names as Spark SQL has them."""
    return _CALL.sub(lambda m: _NAMES[m[1].lower()], formula)


def haversin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat, dlon = p2 - p1, F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def validate(spark: SparkSession, formula: str) -> None:
    """Fail early on an invalid formula (analysis only, no data read)."""
    register(spark)
    probe = spark.range(0).selectExpr("0D AS _score", "0D AS score", "id AS docid", "1D AS docMatchCount")
    probe.select(F.expr(sql_formula(formula)).cast("double")).schema  # noqa: B018
