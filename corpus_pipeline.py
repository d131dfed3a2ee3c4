"""From raw documents to training shards in five stages, each by one operator of ``llm``.

A stage works on all rows that the one before it kept. Its result is written as Parquet in
the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm import common, decontaminate, mixing, neardup, quality, sharding

#: Columns of documents that the operators read; the others are set aside while a stage runs.
READ = ("doc_id", "text", "source", "lang", "n_chars")
_ASIDE = "_pipeline_own_"


def _own_columns_kept(stage):
    """The stage with every other column of the documents set aside and given back unchanged.

    Operators add columns such as ``size``, ``taken`` or ``shard``; a document's own columns
    of such names keep their values. Where the stage's result has a column of that name (the
    last stage's ``shard`` and ``slot``), the document's own comes back as ``own_<name>``.
    """
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c not in READ]
        result = stage(spark, docs.withColumnsRenamed({c: _ASIDE + c for c in own}), sf_dir)
        back = {}
        for c in own:
            back[_ASIDE + c] = f"own_{c}" if c in result.columns else c
        return result.withColumnsRenamed(back)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; their texts stay whole."""
    return quality.kept_rows(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates.

    Rows that share the kept id all stay, and so do rows without an id.
    """
    kept = neardup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_lm_gone")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_lm_gone"), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order of finish time; a document that is taken twice is there twice."""
    return mixing.in_order(mixing.mix(docs), docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and slot."""
    return sharding.shuffle_to_shards(docs)


STAGES = [
    ("quality rules", _own_columns_kept(quality_rules)),
    ("near duplicates", _own_columns_kept(one_of_each_group)),
    ("decontamination", _own_columns_kept(without_benchmark)),
    ("mixing", _own_columns_kept(mixing_weights)),
    ("sharding", _own_columns_kept(shards)),
]

#: The stages need iteration and random draws, which SQL cannot express; tests hold them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
