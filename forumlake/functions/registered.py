"""The text functions under names for SQL, as SQL functions, which the optimizer takes apart like any expression."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: Name: the arguments and the function over them.
FUNCTIONS = {
    "forum_collapse": (("t",), X.collapse), "forum_slug": (("t",), X.slugify), "forum_filename": (("t",), X.sanitize_filename), "forum_snippet": (("t",), X.snippet),
    "forum_motion": (("t",), X.motion_type), "forum_subject": (("t",), X.subject), "forum_uuid": (("t",), X.uuid5_url), "forum_short_sha1": (("t",), X.short_sha1),
}


def _sql(spark: SparkSession, use: Column, names: tuple[str, ...]) -> str:
    """An expression as SQL text, from the plan that analyses it."""
    frame = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).select(use.alias("x"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL and returns their names."""
    for name, (names, make) in FUNCTIONS.items():
        body = _sql(spark, make(*map(F.col, names)), names)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{n} STRING' for n in names)}) RETURNS STRING RETURN {body}")
    return list(FUNCTIONS)
