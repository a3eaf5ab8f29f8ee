"""A text preparation pipeline over the operators of `corpusloom.llm`.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents. `run` writes every stage to the shared folder
and reads it back, so no stage is computed twice or depends on executors of an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import classifier, decontaminate, lines, packing, simhash
from corpusloom.llm.common import fresh, stored, table
from corpusloom.llm.queries import tokenizer


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on the stage's own input."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return classifier.scores(docs, model, out=score).where(classifier.accepted(F.col(score))).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; `n_chars` follows the text."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed; one row per piece."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", accept),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# XXH64 fingerprints, the fitted classifier and the tokenizer have no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
