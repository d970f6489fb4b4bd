"""A training-data pipeline: five stages, each one operator applied to what the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` applies them to ``documents``,
each stage's result written as Parquet in the shared folder and read again.

Defined cases, for every stage: a null text counts as empty (only ``drop_lines``
writes it as an empty one); nulls in other columns stay; rows that repeat, whole or
by doc_id, go through as rows of their own but for ``drop_near_copies``, where of
rows that share the smallest doc_id of a group one stays; texts of any length are
read whole; an empty table gives an empty one of the same columns; columns other
than those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove.llm.common import save, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from their labels.

    Empty texts score by the labels' shares alone; without labels all score 0.5 and stay.
    """
    from docgrove.llm.quality import classify, fit

    ship(spark)
    docs = docs.select(*COLUMNS)
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"))).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows. A text may become empty; no row goes."""
    from docgrove.llm.line_dedup import dedup_lines

    ship(spark)
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows without words or with a null doc_id all stay."""
    from docgrove.llm.ngram_join import kept_documents

    ship(spark)
    return kept_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, longer ones likelier; a null source is one of its own, a document without words isn't taken."""
    from docgrove.llm.mixing import mixed_documents

    ship(spark)
    return mixed_documents(docs.select(*COLUMNS), by_size=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences; an empty text is one id."""
    from docgrove.llm.packing import pack

    ship(spark)
    return pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
