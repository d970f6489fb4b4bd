r"""Corpus-wide line dedup.

A line's key is the line stripped of ``[\x20\x09-\x0D]`` at both ends with A-Z
lower-cased. Keys of at least ``min_chars`` code points that are found in at
least ``min_docs`` documents lose all their lines except those of the largest
doc_id that holds them. What stays is joined in its old order.

Scale: a document sends each of its distinct long keys once, as a 128-bit hash;
counts are partial before they are shuffled, so a line of a third of the corpus
costs a few rows a task. The join of keys to the frequent ones is salted. Texts
are shuffled once, to meet their lists of dropped keys, and only documents that
lose lines are rebuilt.

Defined cases: a null or empty text is one empty line and stays empty; rows with
one doc_id count as one document; a null doc_id is smaller than any other; an
empty table gives no rows; other columns pass through, ``n_lines`` and
``n_dropped`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, save, unused

SPACE = b" \t\n\x0b\x0c\r"
SALTS = 16


def long_key(line: bytes, min_chars: int) -> bytes | None:
    """The hashed key of a line, or None where the key is too short."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys(min_chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                if text and len(text) >= min_chars:
                    own = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := long_key(line, min_chars))}
                    keys += own
                    ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _rebuild(min_chars: int, text_at: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = pc.fill_null(batch.column(text_at), "")
            drops = batch.column(batch.num_columns - 1).to_pylist()
            lines = pc.add(pc.count_substring(texts.cast(pa.large_binary()), b"\n").cast(pa.int64()), 1)
            lost = [0] * len(drops)
            hit = [i for i, d in enumerate(drops) if d]
            if hit:
                out = texts.to_pylist()
                for i in hit:
                    gone = set(drops[i])
                    all_lines = out[i].encode().split(b"\n")
                    kept = [x for x in all_lines if len(x) < min_chars or long_key(x, min_chars) not in gone]
                    lost[i] = len(all_lines) - len(kept)
                    out[i] = b"\n".join(kept).decode()
                texts = pa.array(out, batch.schema.field(text_at).type)
            columns = batch.columns[:-1]
            columns[text_at] = texts
            yield pa.RecordBatch.from_arrays([*columns, lines, pa.array(lost, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, text: str = "text") -> DataFrame:
    """The documents with their texts rebuilt, ``n_lines`` (before) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    held = docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(lean(_keys(min_chars)), "doc_id long, key binary")
    held = save(held.distinct())
    frequent = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    frequent = frequent.select("key", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
    salted = held.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    drops = salted.join(frequent, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    of, keys = unused(docs, "doc", "drops")
    drops = drops.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list("key").alias(keys))
    both = docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(drops[of]), "left").drop(of)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return both.mapInArrow(lean(_rebuild(min_chars, docs.columns.index(text))), schema)
