"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of ``documents``. Empty tables pass through; further columns are carried, texts of any length are whole.
``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut, shared_dir, stored, table
from quadrille.llm.op01_quality_rules import quality_rules
from quadrille.llm.op05_mix import mixed
from quadrille.llm.op07_secrets import mask_secrets
from quadrille.llm.op08_decontaminate import contaminated
from quadrille.llm.op10_near_dup import near_duplicates

#: A key of each row of a stage's input, since ids may be null or repeat: the number of its file and its place there.
_ROW = "_row"
_ROWS_A_FILE = 1 << 36


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with a key each, the same for every reader; docs that are no plain table of files become one."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs)
    file, place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")
    files = sorted(r[0] for r in docs.select(file).distinct().collect())  # names of files, not rows
    numbered = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number bigint")
    rows = docs.select("*", file, place).join(F.broadcast(numbered), "_file")
    return rows.select(*docs.columns, (F.col("_number") * _ROWS_A_FILE + F.col("_place")).alias(_ROW))


def _without(docs: DataFrame, rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The columns of docs of the rows whose key is not among the dropped ones, which Spark broadcasts if they are few."""
    return rows.join(stored(dropped.select(_ROW)), _ROW, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, row by row where ids are null or repeat."""
    rows = _keyed(spark, docs)
    return _without(docs, rows, quality_rules(rows, id_col=_ROW).where("not kept").select(F.col("doc_id").alias(_ROW)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, 0.8) the document of least id, null being last.

    One row stays of those that repeat an id inside a group; rows of one id in two groups are two documents.
    """
    rows = _keyed(spark, docs)
    groups = near_duplicates(rows, id_col=_ROW, shingle=5, percent=80).select(F.col("doc_id").alias(_ROW), "component_id")
    groups = cut(groups.join(rows.select(_ROW, "doc_id"), _ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _ROW))[_ROW]
    kept = groups.groupBy("component_id").agg(first.alias(_ROW)).select(_ROW)
    return _without(docs, rows, groups.join(kept, _ROW, "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that is 0.8 similar to a benchmark item, row by row where ids are null or repeat."""
    rows = _keyed(spark, docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=_ROW).select(F.col("doc_id").alias(_ROW)).distinct()
    return _without(docs, rows, found)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; documents stay, with n_chars that of the masked text."""
    masked = mask_secrets(docs)
    changed = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources: doc_id, size, source_size, target, taken, copies."""
    return mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Mahalanobis distances and hash-driven rounding have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
