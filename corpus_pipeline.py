"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and source mix, each over what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns documents: the columns of its input, and in the last stage those of the mix
besides. `n_chars`, where there is one, follows the text. Nulls, empty texts and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import read, written
from gleaner.llm.decontaminate import decontaminate
from gleaner.llm.line_dedup import dedup_lines
from gleaner.llm.mixing import mixed_rows
from gleaner.llm.near_dedup import drop_near_duplicates
from gleaner.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return drop_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), min_words=1)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of the mix."""
    return mixed_rows(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("source mix", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A character model, a regression and LSH are no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
