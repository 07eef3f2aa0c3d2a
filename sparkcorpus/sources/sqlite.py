"""Tables of SQLite files, read in key ranges by many tasks (no JDBC driver is needed)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.text import is_blank
from sparkcorpus.functions.vectors import from_blob
from sparkcorpus.operators.fulltext import postings


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_table(spark: SparkSession, path: str, name: str, schema: str, tasks: int = 8) -> DataFrame:
    """A table as a DataFrame; the file must lie where every executor can read it. Ranges of rowid are read in parallel."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for part in batches:
                for start in part["id"]:
                    cursor = db.execute(f"select {', '.join(map(_quoted, columns))} from {_quoted(name)} where rowid >= ? and rowid < ?", (int(start), int(start) + step))
                    while rows := cursor.fetchmany(2_000):
                        yield pd.DataFrame(rows, columns=columns)

    return spark.range(low, high + 1, step, numPartitions=tasks).mapInPandas(run, schema)


def read_vectors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """source_article_id, chunk_sequence_id, chunk_text, embedding of a vector table whose vectors are blobs of floats."""
    rows = read_table(spark, path, name, "article_id bigint, chunk_id int, text string, embedding binary")
    return rows.select(F.col("article_id").alias("source_article_id"), F.col("chunk_id").alias("chunk_sequence_id"), F.col("text").alias("chunk_text"), from_blob("embedding").alias("embedding"))


def read_articles(spark: SparkSession, path: str, name: str = "articles") -> DataFrame:
    """Articles with their casts: empty and zero dates are null, times are UTC."""
    rows = read_table(spark, path, name, "id bigint, headword string, xhtml_md string, permalink string, encyclopedia_id bigint, changed_at string, created_at string")
    when = lambda c: F.expr(f"try_cast(if({c} like '0000%', null, {c}) as timestamp)")
    return rows.withColumns({"encyclopedia_id": F.col("encyclopedia_id").cast("int"), "changed_at": when("changed_at"), "created_at": when("created_at")})


def check_load(source_rows: int, loaded: DataFrame) -> None:
    """Raise unless as many rows arrived as the source has, none without its id."""
    rows, missing = loaded.agg(F.count("*"), F.sum(F.col("id").isNull().cast("int"))).first()
    if rows != source_rows or missing:
        raise ValueError(f"{rows} of {source_rows} rows arrived, {missing or 0} without an id")


def check_search(loaded: DataFrame, text_col: str = "xhtml_md", analyser: str = "danish") -> None:
    """Raise where rows have text and full text finds no lexeme in any of them."""
    texts = loaded.where(~is_blank(F.col(text_col)))
    if not texts.isEmpty() and postings(texts, "id", text_col, analyser).isEmpty():
        raise ValueError("the loaded texts can't be searched")
