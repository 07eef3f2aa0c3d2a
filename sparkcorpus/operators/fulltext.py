"""Ranked full-text search of many queries over many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcorpus.functions.analysis import ANALYSERS
from sparkcorpus.session import cut_lineage


def postings(docs: DataFrame, id_col: str, text_col: str, analyser: str = "simple") -> DataFrame:
    """id, lexeme, tf: the inverted index, one row for each lexeme of a document."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(ANALYSERS[analyser](F.col(text_col))).alias("lexeme"))
    return words.groupBy("id", "lexeme").agg(F.count("*").alias("tf"))


def postings_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, analyser: str = "simple") -> DataFrame:
    """``postings`` of the lexemes in ``wanted`` only: others go before anything is shuffled."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(ANALYSERS[analyser](F.col(text_col))).alias("lexeme"))
    return words.join(wanted, "lexeme", "left_semi").groupBy("id", "lexeme").agg(F.count("*").alias("tf"))


def matches(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str, analyser: str = "simple") -> DataFrame:
    """query, id, score of every document that holds all lexemes of a query.

    Score: mean over the query's lexemes of tf / (tf + 1), rounded to six places. Blank queries, and queries without
    lexemes, match nothing; null texts hold nothing. The documents are read once: the postings of the wanted lexemes are
    written to the shared folder. Each query meets those of its rarest lexeme only; what it finds is then checked for the
    other lexemes, so a word that most documents hold brings no rows together.
    """
    asked = queries.select(F.col(query_col).alias("query"), F.array_distinct(ANALYSERS[analyser](F.col(query_text))).alias("wanted")).where(F.size("wanted") > 0)
    terms = asked.select("query", "wanted", F.explode("wanted").alias("lexeme"))
    needed = cut_lineage(postings_of(docs, id_col, text_col, terms.select("lexeme").distinct(), analyser), "postings")
    frequency = needed.groupBy("lexeme").agg(F.count("*").alias("df"))
    rarest = terms.join(frequency, "lexeme", "left").groupBy("query", "wanted").agg(F.min_by("lexeme", F.struct(F.coalesce("df", F.lit(0)), "lexeme")).alias("lexeme"))
    found = needed.join(rarest, "lexeme").select("query", "wanted", "id", "tf", F.col("lexeme").alias("anchor"))
    # the anchor's own count travels along, so nothing is read a second time for it
    others = found.select("query", "id", F.size("wanted").alias("n"), "tf", F.explode_outer(F.filter("wanted", lambda w: w != F.col("anchor"))).alias("lexeme"))
    more = others.join(needed.withColumnRenamed("tf", "other"), ["id", "lexeme"], "left")
    share = lambda c: F.col(c) / (F.col(c) + 1)
    summed = more.groupBy("query", "id", "n").agg(F.count("other").alias("held"), (F.coalesce(F.sum(share("other")), F.lit(0.0)) + F.first(share("tf"))).alias("total"))
    return summed.where("held = n - 1").select("query", "id", F.round(F.col("total") / F.col("n"), 6).alias("score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best matches of each query with ``rank`` from 1 and ``total`` matches before the limit; ties by id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    totals = found.groupBy("query").agg(F.count("*").alias("total"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(totals, "query")


def search(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str, k: int = 50, analyser: str = "simple", ids: DataFrame | None = None) -> DataFrame:
    """query, id, score, rank, total of the k best documents; ``ids`` restricts the documents (an empty one is no filter's business: it matches none)."""
    if ids is not None:
        docs = docs.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    return best(matches(docs, id_col, text_col, queries, query_col, query_text, analyser), k)
