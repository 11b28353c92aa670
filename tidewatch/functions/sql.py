"""SQL-callable names for the scalar functions.

Normalisation is registered as SQL UDFs whose bodies are the same generated SQL text as the
DataFrame path, so they stay native; the LCS kernel is the Arrow-batched pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewatch.functions import similarity as S
from tidewatch.functions.normalize import (
    spark_sql_normalize_location, spark_sql_normalize_title, spark_sql_token_sort,
)


def register_sql_functions(spark: SparkSession, prefix: str = "tw_") -> list[str]:
    """Registers ``{prefix}normalize_title``, ``normalize_location``, ``token_sort``,
    ``signature``, ``lcs_len``, ``ratio``, ``token_sort_ratio`` and ``similarity`` (same-arity
    three-part form: company, title, location for each side). Returns the names."""
    p = prefix
    spark.udf.register(f"{p}lcs_len", S.lcs_len_udf)
    defs = {
        f"{p}normalize_title": ("t STRING", "STRING", spark_sql_normalize_title("t")),
        f"{p}normalize_location": ("l STRING", "STRING", spark_sql_normalize_location("l")),
        f"{p}token_sort": ("t STRING", "STRING", spark_sql_token_sort("t")),
        f"{p}signature": ("c STRING, t STRING, l STRING", "STRING",
                          f"concat(c, '|', {spark_sql_normalize_title('t')}, '|', {spark_sql_normalize_location('l')})"),
        f"{p}ratio": ("a STRING, b STRING", "DOUBLE",
                      S.ratio_sql("length(a)", "length(b)", f"CASE WHEN a = b THEN length(a) ELSE {p}lcs_len(a, b) END")),
        f"{p}token_sort_ratio": ("a STRING, b STRING", "DOUBLE",
                                 f"{p}ratio({spark_sql_token_sort('a')}, {spark_sql_token_sort('b')})"),
        f"{p}similarity": ("c1 STRING, t1 STRING, l1 STRING, c2 STRING, t2 STRING, l2 STRING", "DOUBLE",
                           S.combine_sql(f"{p}ratio(c1, c2)", f"{p}token_sort_ratio(t1, t2)", f"{p}ratio(l1, l2)")),
    }
    for name, (params, ret, body) in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return [f"{p}lcs_len", *defs]
