"""The corpus pipeline: documents through five stages, each stored and read again.

Every stage takes whole texts of any length, null and empty ones too, and keeps the columns of its input, whatever else they
are called. A row stands for itself: rows with a null or repeated doc_id are told apart by their text. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchspark.llm import decontam, lines, neardup, packing, quality
from pitchspark.llm.common import read, stored
from pitchspark.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the rules reject; null and empty texts have too few words and go. Repeated rows stay or go together."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that spread over many sites; null and empty texts stay as they are, and no row goes."""
    return lines.without_boilerplate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, nulls first. Of repeated rows one stays; rows without words all stay."""
    return neardup.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark; null and empty texts hold none. Repeated rows stay or go together."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed; a null or empty text is the end id alone. Repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Registers, fingerprints and token ids are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``; none of an empty table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
