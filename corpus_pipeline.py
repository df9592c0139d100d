"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``docs``.  Between
stages the rows are written as Parquet and read again.

The last stage has doc_id, n_tokens, ids and text (decoded).  Rows with a null
text fail the quality rules; an empty table stays empty through all stages.

``ORACLE_SQL`` is None: near duplicates by connected components, the order of
words in a BPE and SimHash have no SQL form; ``tests/llm/test_pipeline.py``
compares ``run`` with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import bpe, decontam, jaccard, lines, quality
from loglens.llm.common import stored, table

ORACLE_SQL = None


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    measured = stored(quality.measure(docs), "quality")
    judged = quality.judge(measured, quality.fit(measured, table(spark, sf_dir, "labels")))
    return judged.where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that documents share stay only in the largest doc_id; n_chars follows the text."""
    deduped = lines.dedup_lines(docs)
    changed = {"text": F.col("_kept")} | ({"n_chars": F.length("_kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return deduped.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    groups = jaccard.join(docs).where(F.col("doc_id") != F.col("component")).select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(groups, docs["doc_id"] == F.col("_other"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage similar to a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, and the text decoded from them."""
    coded = bpe.encode(docs, _vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
