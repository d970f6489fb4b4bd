"""Rankers: how a word of a query scores a document.

Both weigh words by ln(1 + N / f), N being the indexed documents and f those that
hold the word. All is arithmetic on columns; a document's words are its array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: int, holding: int) -> float:
    return math.log(1.0 + n_docs / holding) if holding else 0.0


def log_norm(terms: Column) -> Column:
    """The length of the vector of log-scaled frequencies of a document's words, by runs of the sorted words."""

    def weight(times: Column) -> Column:
        return F.when(times > 0, F.pow(1.0 + F.log(times.cast("double")), F.lit(2.0))).otherwise(0.0)

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(s["word"] == x, F.lit(False))
        return F.when(same, F.struct(x.alias("word"), (s["times"] + 1).alias("times"), s["sum"].alias("sum"))).otherwise(F.struct(x.alias("word"), F.lit(1).alias("times"), (s["sum"] + weight(s["times"])).alias("sum")))

    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("times"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sort_array(F.filter(terms, lambda x: x.isNotNull())), start, step, lambda s: F.sqrt(s["sum"] + weight(s["times"])))


class Okapi:
    """BM25 with a saturation ``k1`` and a length correction ``b``."""

    needs_norm = False

    def __init__(self, k1: float = 1.2, b: float = 0.75) -> None:
        self.k1, self.b = k1, b

    def term_score(self, tf: Column, length: Column, norm: Column | None, weight: float | Column, mean: float) -> Column:
        w = weight if isinstance(weight, Column) else F.lit(weight)
        damp = F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * length / F.lit(mean if mean else 1.0))
        return tf * F.lit(self.k1 + 1.0) / (tf + damp) * w

    def query_weight(self, weights: list[float]) -> float:
        return sum(weights) * (1.0 + self.k1)


class Cosine:
    """Cosine of log-scaled frequencies; ``norm`` is the length of the document's vector."""

    needs_norm = True

    def term_score(self, tf: Column, length: Column, norm: Column | None, weight: float | Column, mean: float) -> Column:
        w = weight if isinstance(weight, Column) else F.lit(weight)
        return (F.lit(1.0) + F.log(tf)) / norm * w

    def query_weight(self, weights: list[float]) -> float:
        return math.sqrt(sum(w * w for w in weights))
