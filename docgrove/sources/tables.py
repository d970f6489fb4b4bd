"""Document tables: reading, writing, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A document table; a schema spares the inference of text formats."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(documents: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}")
    writer = documents.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def delete_rows(documents: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents whose id isn't listed."""
    return documents.join(ids.select(id_col).distinct(), id_col, "left_anti")


def one_each(rows: DataFrame, id_col: str, order: str | None = None) -> DataFrame:
    """One row of each id: the greatest by ``order``, of ties (or without an order) the greatest by the row's JSON; rows without an id are left out.

    An aggregate with partial results: an id that repeats often isn't gathered in one task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    rank = F.struct(F.col(order).isNotNull(), F.col(order), F.to_json(whole)) if order else F.to_json(whole)
    best = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_one_of")).agg(F.max_by(whole, rank).alias("_kept"))
    return best.select("_kept.*")


def upsert_rows(documents: DataFrame, rows: DataFrame, id_col: str, order: str | None = None, unique: bool = False) -> DataFrame:
    """The documents with rows inserted, replacing those of equal id; of rows that repeat an id one counts (see ``one_each``).

    ``unique`` says that no id repeats.
    """
    rows = rows.select(*documents.columns, *([order] if order and order not in documents.columns else []))
    rows = rows if unique else one_each(rows, id_col, order)
    return delete_rows(documents, rows, id_col).unionByName(rows.select(*documents.columns))


def merge_parts(parts: DataFrame, id_col: str, text: str, order: str) -> DataFrame:
    """Texts that lie in several rows (as turns of a conversation) as one array for each id, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy(id_col).agg(F.transform(pairs, lambda p: p[text]).alias(text))
