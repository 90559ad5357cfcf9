"""A training corpus from documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm.common import scratch_path, table
from quillsift.llm.decontaminate import decontaminate
from quillsift.llm.langid import keep_identified, learn, rejecting
from quillsift.llm.line_dedup import dedup_lines
from quillsift.llm.mixing import mix_sources
from quillsift.llm.ngram_join import dedup_ngrams


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go, and those too far from the documents of theirs; profiles and bounds come from all labelled documents themselves."""
    labelled = docs["doc_id"].isNotNull()
    profiles = learn(docs, labelled, train_docs=None)
    return keep_identified(docs, profiles, bounds=rejecting(docs, profiles, labelled, train_docs=None))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; documents whose every line goes, go."""
    left = dedup_lines(docs)
    return left.where("text is null or length(trim(text)) > 0")


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest id stays."""
    return dedup_ngrams(docs, k=5, num=80, den=100)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more of a benchmark item go; documents that are mostly benchmark go altogether."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at least once, small ones up to four times, to 95 % of the greatest entropy where that allows it."""
    return mix_sources(docs, entropy_share=0.95, max_repeats=4.0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_join", keep_one_of_a_group),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_to_weights),
]

#: Language identification is not expressible in SQL. The tests hold its operators against brute force one by one, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
