"""The corpus pipeline: quality, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tsledger.llm import common, exact_dedup, mixing, packing, quality, simhash

ORACLE_SQL = None


#: Tables of stages whose results are stored by the time the next one begins.
_LEFT: list[str] = []


def _stage(function):
    """A stage that first removes what earlier ones left in the shared folder, but for what its input still reads."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
        spent = [p for p in _LEFT if p.rsplit("/", 1)[-1] not in read]
        common.remove(spark, spent)
        _LEFT[:] = [p for p in _LEFT if p not in spent]
        before = set(common.MADE)
        out = function(spark, docs, sf_dir)
        _LEFT.extend(p for p in common.MADE if p not in before)
        return out

    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; each row by itself, so repeated and null ids make no difference.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, null the largest; of rows that repeat id and text one."""
    return exact_dedup.keep_first(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; unrelated rows with null or
    repeated ids all stay, texts without words are copies of one another."""
    return simhash.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document has a row per pass, the one where a budget ends a shorter last one.

    A null source is one of its own; rows with null or repeated ids are budgeted row by row; texts without words stay
    once.
    """
    return mixing.apply_mix(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens; a row per piece.  A null text is one piece with the end token alone; longer documents
    than a sequence are cut."""
    return packing.pack_digests(docs)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.  An empty table gives an empty result; columns beyond
    those of ``documents``, whatever their names, are kept up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = common.table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        _LEFT.append(path)  # its tables, and the stage's before, go when the next stage begins
        common.MADE.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
