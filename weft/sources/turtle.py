"""Reading and writing the one-statement-per-line Turtle that the graph operators write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.graph import XSD, turtle_lines
from weft.plans.sparql import lexical

_LINE = r'^(<[^>]*>|_:\S+) <([^>]*)> (<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>)?) \.$'


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind, o_datatype; blank lines and comments are skipped, any other line fails."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    parsed = lines.select("value", lexical(part(1)).alias("s"), part(2).alias("p"), part(3).alias("term"))
    good = F.when(F.col("p") != "", F.col("p")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.col("value"))))
    datatype = F.coalesce(F.nullif(F.regexp_extract("term", r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(XSD + "string"))
    return parsed.select(
        "s", good.alias("p"), _unescape(lexical(F.col("term"))).alias("o"),
        F.when(F.col("term").startswith("<"), "iri").when(F.col("term").startswith("_:"), "bnode").otherwise("literal").alias("o_kind"),
        F.when(F.col("term").startswith('"'), datatype).alias("o_datatype"),
    )


def _unescape(text):
    for c in [*range(1, 9), 11, 12, *range(14, 32)]:
        text = F.replace(text, F.lit(f"\\u{c:04x}"), F.lit(chr(c)))
    return text


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle_lines(triples).write.mode("overwrite").text(path)
