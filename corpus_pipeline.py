"""A corpus pipeline over ``documents``: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and rereads it as the next stage's documents.  All stages
but the last return the columns of documents.  Classifiers are fitted on the labelled
rows that the stage is given, held-out rows left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import jaccard, packing, quality, toxicity
from loomgraph.llm.common import materialise, table
from loomgraph.llm.queries import BYTE_BPE, BYTE_RANKS, keep_predicted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts (score 0.7 or more; a null or empty text is scored
    as any other).  Repeated rows are judged alike."""
    ranking = quality.learn_ranking(docs, table(spark, sf_dir, "labels"))
    return keep_predicted(docs, lambda d, to: quality.score_documents(d, ranking, to=to), 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic (score under 0.7), null and empty ones among them.
    Repeated rows are judged alike."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return keep_predicted(docs, lambda d, to: toxicity.score_documents(d, model, to=to), 0)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.

    Documents without words, and those without an id, are each their own.  Of repeated
    rows, equal in id and text, one stays, the smallest by its other columns."""
    found = materialise(jaccard.jaccard_components(docs), "components")
    gone = materialise(found.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    again = materialise(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest, F.lit(0))).alias("least"))
    one = rows.select("doc_id", "text", *[F.col(f"least.{c}").alias(c) for c in rest]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(one)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in packed sequences of 1,024."""
    return packing.pack_documents(docs.select("doc_id", "text"), BYTE_BPE, BYTE_RANKS)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("packing", packing_stage)]

#: No stage but the last could be told in SQL, as both classifiers are fitted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
