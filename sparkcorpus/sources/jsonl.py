"""JSON Lines interchange of articles, embeddings and indexes.

A file set begins with a header object under ``_metadata``. Files are read as text and parsed column-wise, so a broken
line is a counted error and never ends a job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcorpus.functions.text import is_blank
from sparkcorpus.functions.vectors import right_size

ARTICLE = "id bigint, headword string, xhtml_md string, permalink string, encyclopedia_id int, changed_at string, created_at string"
EMBEDDING = "article_id string, chunk_idx int, chunk_text string, embedding array<float>"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def parsed_lines(lines: DataFrame, schema: str, required: list[str], line: str = "value") -> DataFrame:
    """The schema's columns and ``valid`` of each line; blank lines and headers are no rows."""
    kind = F.get_json_object(line, "$._metadata")
    rows = lines.where(~is_blank(F.col(line))).where(kind.isNull())
    r = F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"})
    rows = rows.select(r.alias("r"))
    valid = F.col("r").isNotNull()
    for name in required:
        valid = valid & F.col("r")[name].isNotNull()
    return rows.select("r.*", F.coalesce(valid, F.lit(False)).alias("valid"))


def header(spark: SparkSession, path: str) -> dict | None:
    """The header of a file set, None without one."""
    row = spark.read.text(path).where(F.get_json_object("value", "$._metadata").isNotNull()).first()
    return json.loads(row[0])["_metadata"] if row else None


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article rows with ``valid``; the times are parsed, unreadable ones become null."""
    rows = parsed_lines(spark.read.text(path), ARTICLE, ["id"])
    return rows.withColumns({c: F.expr(f"try_cast({c} as timestamp)") for c in ("changed_at", "created_at")})


def read_embeddings(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Chunk rows with ``valid``: a known article, a number, a text and a vector of the right size. A missing header is an error."""
    if header(spark, path) is None:
        raise ValueError("the file has no header")
    rows = parsed_lines(spark.read.text(path), EMBEDDING, ["article_id", "chunk_idx"])
    article = F.expr("try_cast(article_id as bigint)")
    good = F.col("valid") & article.isNotNull() & ~is_blank(F.col("chunk_text")) & right_size(F.col("embedding"), dims)
    return rows.select(article.alias("source_article_id"), F.col("chunk_idx").alias("chunk_sequence_id"), "chunk_text", "embedding", good.alias("valid"))


def article_lines(articles: DataFrame) -> DataFrame:
    """``value``: one JSON object an article, times as ISO 8601 in UTC, nulls kept as null."""
    iso = lambda c: F.date_format(F.col(c), _ISO).alias(c)
    fields = ["id", "headword", "xhtml_md", "permalink", "encyclopedia_id"]
    return articles.select(F.to_json(F.struct(*fields, iso("changed_at"), iso("created_at")), {"ignoreNullFields": "false"}).alias("value"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``value``: one JSON object a chunk."""
    return chunks.select(F.to_json(F.struct(F.col("source_article_id").cast("string").alias("article_id"), F.col("chunk_sequence_id").alias("chunk_idx"), "chunk_text", "embedding"), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str, head: dict) -> None:
    """A folder of text files whose first line is the header; the rows keep their order."""
    spark = lines.sparkSession
    first = spark.createDataFrame([(json.dumps({"_metadata": head}, ensure_ascii=False),)], "value string").coalesce(1)
    first.unionByName(lines).write.text(path)
