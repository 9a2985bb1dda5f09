"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality rules -> n-gram Jaccard join (one document of each group stays) ->
benchmark decontamination -> mixing sources -> token files.

The scratch tables of a stage are deleted when the next one begins; those of other
queries stay.  ``run`` with a folder of its own can be called again after a failure
and goes on behind the last stage that was written whole.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, jaccard_join, mixing, quality_rules, queries, shared, token_files

#: SQL cannot express the token files, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None

_last: list[str] = []


def _stage(f):
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.delete(spark, _last)
        with shared.recorded(_last):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = ("lang", "source", "text")
    return shared.back(quality_rules.quality_rules(shared.aside(docs, own)).filter("kept"), docs, own)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; of rows that repeat an id, all stay or go."""
    groups = jaccard_join.jaccard_groups(docs).filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    gone = shared.materialise(groups, "copies")
    return docs.join(shared.small(gone), "doc_id", "left_anti").select(*docs.columns)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    aside = shared.aside(docs, ("text",))
    return shared.back(decontaminate.decontaminate(aside, benchmark, carry=tuple(aside.columns)).filter(~F.col("contaminated")), docs, ("text",))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mix = mixing.mix_sources(docs)
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.col("epochs"))
    # Rows that repeat a doc_id draw alike; the larger count stands for all of them.
    plan = shared.materialise(mix.groupBy("doc_id").agg(F.max(times).cast("int").alias("mix_times")).filter("mix_times > 0"), "mix")
    aside = shared.aside(docs, ("doc_id",))
    both = aside.join(plan.withColumnRenamed("doc_id", "mix_id").hint("merge"), F.col("doc_id").eqNullSafe(F.col("mix_id")))
    return shared.back(both.withColumn("mix_copy", F.explode(F.expr("array_repeat(1, mix_times)"))), docs, ("doc_id",))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_files.read_tokens(spark, token_files.write_tokens(docs, queries.tokenizer_path()))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixed),
    ("token_files", tokens),
]


def _written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last.

    With ``folder``, stages whose output it already holds are not run again, and
    all outputs stay; without, only that of the last stage does.
    """
    base = folder or f"{shared.shared_dir(spark)}/brindle-pipeline/{shared.token()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        if not _written(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if before and not folder:
            shared.delete(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs
