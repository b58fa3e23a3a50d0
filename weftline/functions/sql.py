"""Functions for SQL: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.operators import personal

#: Functions in SQL itself, which the optimizer sees through.
_EXPRESSIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION weft_plain(t STRING) RETURNS STRING RETURN regexp_replace(trim(lower(coalesce(t, ''))), '\\\\s+', ' ')",
    "CREATE OR REPLACE TEMPORARY FUNCTION weft_reference(t STRING) RETURNS STRING RETURN CASE WHEN lower(trim(t)) IN ('', 'none', 'n/a', '-', 'unknown') THEN NULL ELSE lower(trim(t)) END",
)


def register(spark: SparkSession) -> None:
    """weft_plain(text), weft_reference(text): expressions; weft_card_ok(text), weft_mean(values): Arrow functions; weft_personal(text): a table function of spans."""
    for text in _EXPRESSIONS:
        spark.sql(text)

    @F.pandas_udf("boolean")
    def card_ok(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else personal.luhn_ok("".join(c for c in t if c.isdigit())))

    @F.pandas_udf("double")
    def mean(s: pd.Series) -> float:
        return float(s.mean()) if s.notna().any() else None

    @F.udtf(returnType="start: int, end: int, type: string")
    class Personal:
        def eval(self, text: str):
            yield from personal.found_in(text)

    spark.udf.register("weft_card_ok", card_ok)
    spark.udf.register("weft_mean", mean)
    spark.udtf.register("weft_personal", Personal)
