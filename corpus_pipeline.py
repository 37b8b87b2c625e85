"""A training corpus from raw documents: toxicity, quality rules, near duplicates, packing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorlake.llm.common import written
from floorlake.llm.jaccard import jaccard_components
from floorlake.llm.outliers import quality_rules
from floorlake.llm.packing import pack_documents
from floorlake.llm.toxicity import CUT, fit_toxicity, score_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut. The score is a column, so texts are not shuffled."""
    score = score_column(fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score("text") < CUT)


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are told apart by id and text; of rows equal in both, all stay if one does."""
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    kept = quality_rules(marked, keys=("_mark",)).where("kept").select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_kept")).distinct()
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_kept")), "left_semi").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, once where its row is repeated.

    Documents without an id are in no group and stay.
    """
    firsts = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(firsts, "doc_id", "left_semi").withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"])
    return chosen.select(docs.columns).union(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 ids of what is left."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_outliers), ("near duplicates", drop_near_duplicates), ("packing", pack)]

#: A classifier and robust estimates decide, which SQL cannot express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
