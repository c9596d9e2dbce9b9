"""From raw documents to token ids: five stages, each over all rows that the
one before has kept. Every stage's rows are written as Parquet in the shared
folder and read again by the next.

Defined results: all stages but the last keep the columns of documents, whatever
they are (n_chars is kept up to date if there is one); null text counts as
empty; an empty table gives an empty result. A null doc_id takes part in all
stages. The Jaccard join keeps a document by its id: of rows that repeat an id,
one of each text stays, the first in order of the other columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, ngram_join, piece_bpe, queries, toxicity
from quillon.llm.common import materialize, release, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, finds toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs are cut from the texts; documents with nothing left go."""
    kept = line_dedup.drop_later_copies(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    found = ngram_join.ngram_components(docs)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(first.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("kept_id"))).select("row", "kept_rows")
    # Only rows that repeat an id are compared by their text.
    others = [F.col("row")[c].cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("row.doc_id", F.sha2("row.text", 256)).orderBy(*others, F.lit(0))
    again = kept.filter("kept_rows > 1").withColumn("place", F.row_number().over(same)).filter("place = 1")
    return kept.filter("kept_rows = 1").select("row").unionByName(again.select("row")).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids; what comes back from decoding them is kept as a digest."""
    return piece_bpe.piece_digests(docs, queries.tokenizer_path(queries.PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: SQL can express neither the classifier nor the tiling; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
