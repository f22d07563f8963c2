"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``. Toxic documents go, repeated lines go (with the documents
they leave empty), one document of each group of near copies stays, sources are mixed to their targets (a document
taken twice is there twice), and what is left is packed into sequences of 4096 tokens.

A stage deletes the scratch tables of the stages before it in its thread, whose results are written by then, and no others. So two
pipelines in one driver run in threads of their own, and a stage's result is written before the next stage is called.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import common, line_dedup, mixing, near_dedup, packing, queries, toxicity

#: Scratch tables of the thread's latest stage.
_STATE = threading.local()


def _made() -> list[str]:
    if not hasattr(_STATE, "made"):
        _STATE.made = []
    return _STATE.made


def _begin() -> None:
    common.delete(*_made())
    _made().clear()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin()
    with common.collecting(_made()):
        return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin()
    with common.collecting(_made()):
        return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin()
    with common.collecting(_made()):
        return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin()
    with common.collecting(_made()):
        return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin()
    with common.collecting(_made()):
        return packing.pack(docs, queries.tokenizer_path(queries.WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the edit join and the packing have no SQL form; a test compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/pipeline-{common.new_name()}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(before)
        before = path
    _begin()
    return docs
