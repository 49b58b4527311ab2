"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``, with whatever further columns ``docs`` has, whatever their names.
A caller stores each result as Parquet and reads it again as the next stage's ``docs``; therefore a stage
first deletes the scratch tables and broadcast values of the stage before it in the same run, and lets the executors
collect their garbage: heaps only grow else, over all stages, until an executor's memory does not hold heap and Python workers.

Every stage accepts an empty table (and returns one), null and empty texts, texts of any length and rows
that repeat; what becomes of them is said at each stage.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, decontaminate, langid, lines, minhash, scratch
from tallyhouse.llm.queries import TOKENIZER

#: A document is rejected if it has no language, or if so few of its n-grams belong to the best one.
LEAST_SCORE = 0.05
#: What the stage before holds, for each thread that runs a pipeline.
_BEFORE = threading.local()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables, values = getattr(_BEFORE, "held", ([], []))
        if work.__name__ != "language":  # a new run leaves results of others alone
            scratch.release(spark, tables)
            scratch.destroy_shared(values)
        scratch.tidy_executors(spark)
        tables, values = scratch.written(), scratch.shared()
        with scratch.small_reads(spark):
            out = work(spark, docs, sf_dir)
        _BEFORE.held = [x for x in scratch.written() if x not in tables], [x for x in scratch.shared() if x not in values]
        return out

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter or with hardly any known n-gram go.

    Null and empty texts have no letter and go. Rows that repeat share their fate. Where nothing is labelled, all go.
    """
    names = ("__lang_pred", "__lang_score")
    found = langid.predict(docs, langid.fit(docs), names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near copies of lines leave the texts; ``n_chars`` follows. Every document stays.

    Null and empty texts are unchanged; rows that repeat doc_id and text keep the same lines; a null doc_id is earliest.
    """
    out = lines.deduplicate_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Texts without words and rows without a doc_id stay; of rows that repeat doc_id and text, one stays.
    """
    return minhash.deduplicate(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; rows that repeat share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text that is left. A null text counts as empty; each row gives a row."""
    return bpe.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Fitted language filters and tokens have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is stored in the shared folder."""
    folder = f"{scratch.root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        out = work(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
