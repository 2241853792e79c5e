"""The corpus pipeline: stages (name, function of spark, docs, sf_dir); each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm import decontam, mixing, ngram_join, qda, substring_dedup
from triplane.llm.common import cut
from triplane.llm.queries import label_domains


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = qda.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.where(qda.quality_score(model) >= 0.3)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, Jaccard 0.8."""
    found = ngram_join.jaccard_components(docs, num=80, den=100, k=5)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs["doc_id"] == others["_other"], "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus; n_chars follows the text."""
    done = substring_dedup.dedup(docs, with_text=True, carry=tuple(c for c in docs.columns if c != "text"))
    text = F.col("kept_text")
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"carried.`{c}`") for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


#: Domains that the stages before leave (those of low quality are gone) and the share of all tokens that each is to have.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a rate for each, so that domain token totals meet the targets."""
    labels = label_domains(_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, TARGETS, carry=tuple(docs.columns))
    return mixed.select("carried.*", "n_tokens", "domain", "posterior", "rate")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_to_targets),
]

#: SQL can't express the trained stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage returns is cut from its lineage before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
