"""Whole-table queries of the text problems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkcorpus.llm import bpe, langid, markup, neighbours, packing, sentences
from sparkcorpus.llm import pieces as pieces_
from sparkcorpus.llm.arrow import map_rows, spread
from sparkcorpus.session import cut_lineage, table

CAPACITY = 2_048


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


# -- p3: markup residue


_BLOCK = T.StructType([T.StructField("label", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("left_out", T.BooleanType())])


def cleaned_articles(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """``key``, clean text, residue counts by kind, the number of blocks left out and the labelled blocks, for every row of ``df``.

    A block has its label (text, residue, or gone for markup that left nothing), the kinds of markup found in it and
    whether it was left out. Null texts give null, no residue and no block; repeated rows stay, other columns are not read.
    """
    counts = [f"n_{k}" for k in markup.KINDS]
    schema = _fields((key, df.schema[key].dataType), *([("clean_text", T.StringType())] if with_text else []), *[(n, T.IntegerType()) for n in counts], ("blocks_left_out", T.IntegerType()), ("blocks", T.ArrayType(_BLOCK)))

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        done = [markup.read(t) for t in batch.column(text).to_pylist()]
        out = {key: batch.column(key), "blocks": [[b._asdict() for b in d.blocks] for d in done], "blocks_left_out": [sum(b.left_out and b.label != "gone" for b in d.blocks) for d in done]}
        out |= {n: [d.counts[k] for d in done] for n, k in zip(counts, markup.KINDS)}
        return out | ({"clean_text": [d.text for d in done]} if with_text else {})

    return map_rows(spread(df.select(key, text), [key]), schema, work)


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article row with its clean Markdown, what was converted, and its blocks with their labels."""
    return cleaned_articles(table(spark, sf_dir, "articles"), "row_id", "xhtml_md")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, kind of the left-over markup in the row's blocks."""
    done = cleaned_articles(table(spark, sf_dir, "articles"), "row_id", "xhtml_md", with_text=False)
    return done.select("row_id", F.explode(F.array_distinct(F.flatten("blocks.kinds"))).alias("kind"))


# -- p4: most similar vectors


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, other, sim, rank: the ten most similar chunks of every chunk with a valid vector."""
    return neighbours.most_similar(table(spark, sf_dir, "article_chunks"), "id", "embedding", 64, 10)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a, id_b of the pairs with cosine of at least 0.92 of which one is among the ten most similar of the other."""
    near = neighbours.most_similar(table(spark, sf_dir, "article_chunks"), "id", "embedding", 64, 10, least=0.92)
    return near.where("sim >= 0.92").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# -- p5: sentence units


#: Characters up to which one task reads a text, and chunks into which a longer one is cut at most.
ONE_TASK, MOST_CHUNKS = 8_192, 4_096
_UNIT = T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def sentence_units(df: DataFrame, key: str, text: str, one_task: int = ONE_TASK, chunk: int = sentences.CHUNK) -> DataFrame:
    """``key``, start_char, end_char of the sentence units of every row of ``df``.

    Null and blank texts have no units, repeated rows give their units again, other columns are not read. A text of more
    than ``one_task`` characters leaves the first pass as chunks, which are then read by many tasks: as functions, which
    a prefix scan composes, and again from the situation in which each is entered.
    """
    of_key = (key, df.schema[key].dataType)
    schema = _fields(of_key, ("units", T.ArrayType(_UNIT)), ("row_no", T.LongType()), ("chunk_no", T.IntegerType()), ("chunks", T.IntegerType()), ("at", T.IntegerType()), ("piece", T.StringType()), ("beyond", T.BooleanType()))
    named = lambda units: [{"start_char": a, "end_char": b} for a, b in units]
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                at, rows = [], []
                for k, t in enumerate(batch.column(text).slice(lo, 512).to_pylist()):
                    number += 1
                    if not t or len(t) <= one_task:
                        at.append(lo + k)
                        rows.append((named(sentences.sentences(t, chunk)), number, None, None, None, None, None))
                        continue
                    parts = sentences.pieces(t, max(chunk, len(t) // MOST_CHUNKS))
                    at += [lo + k] * len(parts)
                    rows += [(None, number, n, len(parts), begin, piece, beyond) for n, (begin, piece, beyond) in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]], schema=arrow)

    done = cut_lineage(spread(df.select(key, text), [key]).mapInArrow(cut, schema), "units")
    units = done.where("chunk_no is null").select(key, F.inline("units"))
    long = done.where("chunk_no is not null").drop("units")
    return units if long.isEmpty() else units.unionByName(_long_units(long, key))


def _long_units(long: DataFrame, key: str) -> DataFrame:
    """The units of chunked texts: row_no says which text a chunk is of."""
    dealt = long.repartition(long.sparkSession.sparkContext.defaultParallelism * 2, "row_no", "chunk_no")

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        parts = zip(*[batch.column(c).to_pylist() for c in ("at", "piece", "beyond")])
        return {"row_no": batch.column("row_no"), "chunk_no": batch.column("chunk_no"), "f": [sentences.TRANSDUCER.function(sentences.tokens(p, b), at).tobytes() for at, p, b in parts]}

    functions = map_rows(dealt, _fields(("row_no", T.LongType()), ("chunk_no", T.IntegerType()), ("f", T.BinaryType())), read)
    lists = functions.groupBy("row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "f"))), lambda x: x["f"]).alias("fs"))

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        shape = (-1, len(sentences.TRANSDUCER.entries), 3)
        return {"row_no": batch.column("row_no"), "entries": [sentences.entered(np.frombuffer(b"".join(fs), np.int64).reshape(shape)).tolist() for fs in batch.column("fs").to_pylist()]}

    entries = map_rows(lists, _fields(("row_no", T.LongType()), ("entries", T.ArrayType(T.ArrayType(T.LongType())))), scan)
    entries = entries.select("row_no", F.posexplode("entries").alias("chunk_no", "entry"))

    def give(batch: pa.RecordBatch) -> dict[str, list]:
        parts = zip(*[batch.column(c).to_pylist() for c in ("at", "piece", "beyond", "entry", "chunk_no", "chunks")])
        units = [sentences.piece_units(sentences.tokens(p, b), at, p, tuple(entry), n + 1 == of) for at, p, b, entry, n, of in parts]
        return {key: batch.column(key), "units": [[{"start_char": lo, "end_char": hi} for lo, hi in u] for u in units]}

    return map_rows(long.join(entries, ["row_no", "chunk_no"]), _fields((key, long.schema[key].dataType), ("units", T.ArrayType(_UNIT))), give).select(key, F.inline("units"))


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every article row."""
    return sentence_units(table(spark, sf_dir, "articles"), "row_id", "xhtml_md")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, start_char, end_char: the sentence units of each row in sentence_tasks."""
    tasks = table(spark, sf_dir, "sentence_tasks").select("row_id").distinct()
    rows = spread(table(spark, sf_dir, "articles").select("row_id", "xhtml_md"), ["row_id"]).join(tasks, "row_id", "left_semi")
    return sentence_units(rows, "row_id", "xhtml_md")


# -- p10: languages


def fitted_languages(df: DataFrame, key: str, text: str, label: str) -> langid.CompressionClassifier:
    """Dictionaries from at most about ``langid.TRAIN_ROWS`` rows of each labelled language, chosen by a hash of their
    key, so that one language (or source) with most rows takes nothing from the others; their texts are cut into units
    by the executors."""
    code = langid.label_code(F.col(label))
    counts = {r[0]: r[1] for r in df.groupBy(code.alias("code")).count().where("code is not null").collect()}
    whole = 1 << 52
    below = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, int(min(1.0, langid.TRAIN_ROWS / n) * whole))]) if counts else F.create_map(F.lit(""), F.lit(0))
    # the hash goes first: most rows need no look at their label
    most = max([min(1.0, langid.TRAIN_ROWS / n) for n in counts.values()], default=0.0)
    mixed = F.pmod(F.xxhash64(key), F.lit(whole))
    sample = df.where((mixed < int(most * whole)) & (mixed < F.coalesce(F.try_element_at(below, code), F.lit(0)))).where(F.col(text).isNotNull()).select(label, text)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        return {"label": batch.column(label), "units": [langid.units_of(t) for t in batch.column(text).to_pylist()]}

    units = map_rows(spread(sample, [text]), _fields(("label", T.StringType()), ("units", T.ArrayType(T.StringType()))), work)
    return langid.fit(sorted((r[0], r[1]) for r in units.collect()))


def languages(df: DataFrame, key: str, text: str, label: str, model: langid.CompressionClassifier | None = None, detailed: bool = True) -> DataFrame:
    """``key``, main language, confidence, cases and segments (start, end, language, confidence) of every row; instead of
    the segments the text's languages where it is not ``detailed``.

    Texts without letters, empty and null ones have no language, no case and no segment; a text that is rejected has a
    segment without language. Repeated rows stay repeated; other columns are not read.
    """
    model = model or fitted_languages(df, key, text, label)
    part = T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("lang_code", T.StringType()), T.StructField("confidence", T.DoubleType())])
    last = ("segments", T.ArrayType(part)) if detailed else ("langs", T.ArrayType(T.StringType()))
    schema = _fields((key, df.schema[key].dataType), ("main_lang", T.StringType()), ("confidence", T.DoubleType()), ("cases", T.ArrayType(T.StringType())), last)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        done = [langid.judge(shared.value, t, n) for t, n in zip(batch.column(text).to_pylist(), batch.column(label).to_pylist())]
        out = {key: batch.column(key), "main_lang": [d[0] for d in done], "confidence": [float(d[1]) for d in done], "cases": [d[2] for d in done]}
        if not detailed:
            return out | {"langs": [sorted({p[2] for p in d[3] if p[2]}) for d in done]}
        names = ("start_char", "end_char", "lang_code", "confidence")
        return out | {"segments": [[dict(zip(names, p)) for p in d[3]] for d in done]}

    return map_rows(spread(df.select(key, text, label), [key]), schema, work)


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language, confidence, and segments by language."""
    return languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, lang_code of missing and wrong labels and of mixed texts."""
    rows = languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", detailed=False).select("doc_id", F.explode("cases").alias("kind"), "main_lang", "langs")
    return rows.select("doc_id", "kind", F.explode(F.when(F.col("kind") == "mixed", F.col("langs")).otherwise(F.array("main_lang"))).alias("lang_code"))


# -- p7: oversized texts


def _index_limits(spark: SparkSession, sf_dir: str, index: str = "article_chunks") -> tuple[int, int]:
    row = table(spark, sf_dir, "vector_index_metadata").where(F.col("index_name") == index).select("chunk_size", "chunk_overlap").first()
    return row[0], row[1]


def _oversized(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    """item, row_key, cuts of every article body and stored chunk over the index's limit."""
    limit, overlap = _index_limits(spark, sf_dir)
    a = table(spark, sf_dir, "articles").select(F.lit("article").alias("item"), F.col("row_id").alias("row_key"), F.col("xhtml_md").alias("body"))
    c = table(spark, sf_dir, "article_chunks").select(F.lit("chunk").alias("item"), F.col("id").alias("row_key"), F.col("chunk_text").alias("body"))
    return pieces_.split_oversized(a.unionByName(c), "body", limit, overlap, with_text=with_text)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, row_key of the texts that come out in more than one piece."""
    return _oversized(spark, sf_dir, False).where(F.size("cuts") > 1).select("item", "row_key")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered pieces of every oversized text."""
    return pieces_.pieces(_oversized(spark, sf_dir, True))


# -- p8: token ids


def token_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_DIR, counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens``) of every row; empty and null texts give an empty list (0)."""
    schema = _fields((key, df.schema[key].dataType), ("n_tokens", T.LongType()) if counts_only else ("ids", T.ArrayType(T.IntegerType())))

    make = bpe.shipped(df.sparkSession, name, folder)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        encode = make().encode
        ids = (encode(t) for t in batch.column(text).to_pylist())
        return {key: batch.column(key)} | ({"n_tokens": [len(x) for x in ids]} if counts_only else {"ids": list(ids)})

    return map_rows(spread(df.select(key, text), [key]), schema, work)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k, without special tokens."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


# -- p9: containers


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True)
    return packing.pack(cut_lineage(sizes, "sizes"), "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_no, piece_size, container_id of every document."""
    return packed_documents(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in tenths of the capacity."""
    boxes = packed_documents(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("piece_size").alias("used"), F.count("*").alias("items"))
    return boxes.groupBy(F.floor(F.col("used") * 10 / CAPACITY).alias("tenths")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that packing has to divide because they exceed one container."""
    return packed_documents(spark, sf_dir).where("piece_no = 1").select("doc_id")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_units": p5_units, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p9_found": p9_found, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_languages": p10_languages}
ORACLES = {
    "p4_found": """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM article_chunks WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        n AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 10)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE sim >= 0.92""",
    "p7_found": "SELECT 'article' AS item, row_id AS row_key FROM articles WHERE length(xhtml_md) > 700 UNION ALL SELECT 'chunk' AS item, id AS row_key FROM article_chunks WHERE length(chunk_text) > 700",
}
