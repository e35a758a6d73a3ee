"""A training corpus from documents in five stages: quality rules, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ampliscope.llm import packing, pii, quality, similar, suffix
from ampliscope.llm.common import release, shared_dir
from ampliscope.llm.queries import TOKENIZER


def _fresh(spark: SparkSession, name: str) -> str:
    """A stage's scratch name; scratch of other stages, whose results are written by now, goes."""
    for stage in _NAMES:
        release(spark, f"stage-{stage}")
    return f"stage-{name}"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts go; repeated rows all stay or all go."""
    return quality.kept(docs, owner=_fresh(spark, "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (a null id counts as less). Repeated rows leave one."""
    return similar.deduplicated(docs, owner=_fresh(spark, "simhash"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 200 bytes that occur again anywhere; ties do not matter, as all occurrences go. Null texts stay null."""
    return suffix.deduplicated(docs, owner=_fresh(spark, "suffix"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and secrets masked in text. Null texts stay null; repeated rows are masked alike."""
    _fresh(spark, "pii")
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences (packing.packed). Null texts are packed as empty; repeated rows as they come."""
    return packing.packed(docs, TOKENIZER, owner=_fresh(spark, "packing"))


STAGES = [("quality", keep_good), ("simhash", drop_near_duplicates), ("suffix", cut_repeats), ("pii", mask_personal_data), ("packing", pack)]
_NAMES = [name for name, _ in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again.

    The stages define what becomes of nulls, empty texts and repeated rows; an empty table gives an empty result, and extra
    columns come through the first four stages as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/ampliscope/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The model stages and cuts on bytes have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None
