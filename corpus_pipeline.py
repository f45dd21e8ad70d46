"""Documents, cleaned stage by stage and packed for training.

Each stage takes the documents that its predecessor kept and, but for the last, returns the columns of
documents: quality rules drop what fails them, of each group of near copies the smallest doc_id stays, documents
with a passage of the benchmark go, secrets are replaced by their kind, and what is left is packed.

All stages take documents with any further columns and any of them null. A null or empty text fails the quality rules;
the later stages, where such a text may come from elsewhere, keep it. Repeated rows are judged alike, and one of them is left after the
join; ties between copies go to the smaller doc_id, and a null doc_id comes last. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import materialise, table
from oddsmill.llm.decontaminate import without_leaks
from oddsmill.llm.jaccard_join import representatives
from oddsmill.llm.packing import default_tokenizer, digest, pack_documents
from oddsmill.llm.quality import accepted
from oddsmill.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that ``quality`` keeps: fifty words or more, not too repetitive by windows of three words or by repeated passages."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, as near copies are taken on the way to training."""
    return representatives(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage within the edit budget of an item of ``benchmark``."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by their kind; n_chars follows the text, null for a null one."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens, as the packing query returns them."""
    return digest(pack_documents(docs, default_tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

ORACLE_SQL = None  # the suffix arrays and alignments have no SQL: tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
