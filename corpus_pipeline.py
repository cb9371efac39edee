"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in
the shared folder and reads them again. All but the last return the columns of documents. A stage deletes the tables that the one before
it worked with, so its own input must be written rows, not a plan over the stage before.

Cases, as the operators state them: null and empty texts have no toxic word, are copies of each other (one stays), have no shingles and
no tokens; very long texts are read whole; repeated rows are copies; of ties the smallest doc_id, then the least hash of the text stays; null doc_ids
come last. Empty tables give empty tables at each stage. Columns beside those of documents are dropped, whatever their names.

SQL can't express toxicity, the Jaccard components or BPE, so ORACLE_SQL is None and the pipeline is
tested against a brute-force version on small tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from leafline.llm.common import drop, sweep, table, tracked, written
from leafline.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; labels of held-out rows teach nothing."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.fit_score(docs, labels, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row of the smallest doc_id."""
    return exact_dedup.kept(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by Jaccard similarity of 0.8 or more on five-word shingles, the one of the smallest doc_id."""
    return ngram_join.kept(docs, COLUMNS, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents in the order of training; a row for each pass."""
    return mixing.mix(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables go when the next one is called, as by then its rows are written."""

    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        with tracked(spark):
            return work(spark, docs, sf_dir)

    return call


STAGES = [
    ("toxicity", stage(drop_toxic)),
    ("exact dedup", stage(drop_copies)),
    ("n-gram Jaccard join", stage(drop_near_copies)),
    ("mixing", stage(mix_sources)),
    ("byte-level BPE", stage(encode)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        docs = written(spark, work(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(spark, before)
        before = docs
    sweep(spark)
    return docs
