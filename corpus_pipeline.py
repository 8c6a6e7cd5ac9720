"""A training-corpus pipeline of five stages over ``documents``.

Each stage reads what its predecessor kept, written as Parquet into the shared folder; all
but the last return the columns of ``documents``.

* toxicity: documents that the scorer predicts to be toxic go;
* line_dedup: lines of recurring templates go but for the first; a document that held lines
  and is left without any goes too;
* near_duplicates: of each component of near-duplicate documents (shingles of ``NEAR_WORDS``
  words, similarity ``NEAR_PERCENT`` or more) the first stays (lowest doc_id, then lowest hash
  of the text; rows without words are no duplicates of each other);
* decontaminate: documents that hold a benchmark item go;
* packing: the rest is tokenized and packed into sequences (its rows are pieces).

Nulls and ties: a null text is empty: not toxic, without lines or words, it stays until it is
packed as an end id alone. Null ids are ids like others; rows that share an id are told apart
by their text, but for decontamination, which drops all rows of an id that leaks. Rows equal
in id and text are copies: one stays in near_duplicates if it has words, all are kept by the
other stages. Columns of any name besides doc_id and text come through as they are (n_chars,
where there is one, is counted anew when lines go). An empty table gives empty results.

A stage deletes the tables that the stage before it in its thread has staged for itself, so a
stage's result must be written before the next stage is called; ``run`` deletes each stage's
result but the last when the next one is written.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.llm import decontaminate as benchmark_templates
from mossgrid.llm import line_templates, ngram_join, packing, toxicity
from mossgrid.llm.shared import drop_staged, read, staged, staged_folders

#: Words in a shingle and least similarity of near duplicates; op10's query has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80
_of_last = threading.local()


def _drop_of_last(spark: SparkSession) -> None:
    """Delete what the stage before has staged, called in this thread."""
    drop_staged(spark, getattr(_of_last, "folders", []))


def _filtered(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on the columns under names that cannot clash with its own."""
    _drop_of_last(docs.sparkSession)
    before = set(staged_folders())
    held = {c: c if c in ("doc_id", "text") else f"column {k}" for k, c in enumerate(docs.columns)}
    out = step(docs.select([F.col(f"`{c}`").alias(x) for c, x in held.items()]))
    _of_last.folders = [x for x in staged_folders() if x not in before]
    return out.select([F.col(f"`{x}`").alias(c) for c, x in held.items()])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, lambda own: toxicity.scored(own, read(spark, sf_dir, "labels")).where("predicted = 0"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(own: DataFrame) -> DataFrame:
        out = line_templates.clean(own, short=True, several=True)
        out = out.where((F.col("n_dropped") == 0) | (F.length(F.trim(F.col("text"))) > 0))
        if "n_chars" in docs.columns:
            name = own.columns[docs.columns.index("n_chars")]
            out = out.withColumn(name, F.when(F.col("n_dropped") == 0, F.col(f"`{name}`")).otherwise(F.length("text")).cast(own.schema[name].dataType))
        return out

    return _filtered(docs, step)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, lambda own: ngram_join.distinct_documents(own, size=NEAR_WORDS, percent=NEAR_PERCENT))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, lambda own: benchmark_templates.decontaminated(own, read(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _drop_of_last(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Toxicity, tokenization and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held: list[str] = []
    for name, stage in STAGES[:-1]:
        last, held = held, []
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}", held)
        drop_staged(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
