"""Search by sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions import scalars, text
from newslens.plans.query import View, matches

SNIPPET = 200


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per sentence, with its place and normalised text."""
    rows = docs.select(*[c for c in docs.columns if c not in (text_col, "norm")], F.posexplode(text.sentences(F.col(text_col))).alias("sent_idx", "sentence"))
    return rows.where(F.trim("sentence") != "").withColumn("norm", text.norm(F.col("sentence")))


def search(docs: DataFrame, query: str, fields: View, quotes_only: bool = False) -> DataFrame:
    """Sentences that match as a whole, with a snippet."""
    found = sentences(docs).where(matches(query, fields))
    if quotes_only:
        found = found.where(text.is_quote(F.col("sentence")))
    return found.withColumn("snippet", scalars.shorten(F.col("sentence"), SNIPPET))
