"""From query trees to columns.

A tree over field, keyword and facet indexes becomes one boolean column: a scan
and a filter. Text predicates add a score column. Their corpus numbers (documents,
total length, documents that hold each query word) come from one aggregate for
a tree's text index; they are as many as the query has words, so they become literals.
Globs, whose words are as many as the vocabulary allows, are scored by postings
and joined by id. Where a text index keeps its postings, no text is read: the query's
words' rows are met by id, alone if the tree is one text query, else joined to the frame.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import textquery as Q
from ..functions.analysis import glob_pattern, glob_prefix
from ..functions.ranking import idf, log_norm
from ..operators import nodes as N
from ..operators.indexes import KeywordIndex, TextIndex

#: What a member of an unscored set weighs beside scored ones.
SET_WEIGHT = 1.0


@dataclass
class Leg:
    """Which rows a node holds for, and their score; a plain set has none."""

    member: Column
    score: Column | None = None


def _times(terms: Column, word: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == F.lit(word)))


class Derived:
    """Numbers of a document's derived words as columns of a frame, made by ``derive``; NULL where it has no text."""

    def __init__(self, name: str, at: dict[str, int], phrases: dict[tuple, int], needs_norm: bool = False) -> None:
        self.name, self.at, self.phrases, self.needs_norm = name, at, phrases, needs_norm

    def derive(self, frame: DataFrame, terms: str) -> DataFrame:
        """The frame with these columns. The words are bound to a variable and the columns made by a generator, through
        which no filter is pushed: an expression in their place would analyse the text anew wherever they are used,
        inside lambdas for each of its words."""

        def numbers(t: Column) -> Column:
            times = [_times(t, w).alias(f"{self.name}_tf_{i}") for w, i in self.at.items()]
            rows = [self._row(t, p).alias(f"{self.name}_row_{i}") for p, i in self.phrases.items()]
            norm = [F.when(F.exists(t, lambda x: x.isin(*self.at)), log_norm(t)).alias(f"{self.name}_norm")] if self.needs_norm else []
            return F.struct(F.when(t.isNotNull(), F.size(t)).alias(f"{self.name}_len"), *times, *rows, *norm)

        return frame.select("*", F.inline(F.transform(F.array(F.col(terms)), numbers)))

    @staticmethod
    def _row(t: Column, words: tuple) -> Column:
        has = reduce(and_, [F.array_contains(t, F.lit(w)) for w in dict.fromkeys(words)])
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - len(words), F.lit(0)))
        return F.when(has, F.exists(starts, lambda i: reduce(and_, [F.get(t, i + k) == F.lit(w) for k, w in enumerate(words)])))

    def holds(self, word: str) -> Column:
        return F.coalesce(F.col(f"{self.name}_tf_{self.at[word]}") > 0, F.lit(False))

    def times(self, word: str) -> Column:
        return F.col(f"{self.name}_tf_{self.at[word]}").cast("double")

    def length(self) -> Column:
        return F.col(f"{self.name}_len")

    def norm(self) -> Column | None:
        return F.col(f"{self.name}_norm") if self.needs_norm else None

    def in_a_row(self, words: list[str]) -> Column:
        return F.coalesce(F.col(f"{self.name}_row_{self.phrases[tuple(words)]}"), F.lit(False))


class Kept:
    """Words of a document as columns met from kept postings; NULL where it lacks the word."""

    def __init__(self, name: str, at: dict[str, int]) -> None:
        self.name, self.at = name, at

    def holds(self, word: str) -> Column:
        return F.col(f"{self.name}_tf_{self.at[word]}").isNotNull()

    def times(self, word: str) -> Column:
        return F.coalesce(F.col(f"{self.name}_tf_{self.at[word]}"), F.lit(0)).cast("double")

    def length(self) -> Column:
        return F.col(f"{self.name}_len")

    def norm(self) -> Column:
        return F.col(f"{self.name}_norm")

    def in_a_row(self, words: list[str]) -> Column:
        def begins(i: int) -> Column:
            return F.transform(F.col(f"{self.name}_at_{self.at[words[i]]}"), lambda p: p - i)

        both = reduce(F.array_intersect, [begins(i) for i in range(len(words))])
        return F.coalesce(F.size(both) > 0, F.lit(False))


Rows = Derived | Kept


class Compiler:
    """Compiles a tree over a catalog's frame. ``frame`` may gain joined columns on the way."""

    def __init__(self, catalog: Any) -> None:
        self.catalog = catalog
        self.frame: DataFrame = catalog.frame()
        self._joined = 0
        self._alone = False  # the frame is only what a kept index found
        self._needed: set[int] = set()  # text queries without which there is no result

    def run(self, query: N.Query) -> tuple[DataFrame, bool]:
        """(id and, if scored, score; whether it is scored)."""
        if isinstance(query, (N.Eq, N.Contains)) and isinstance(query.index, TextIndex) and query.index.kept is not None:
            self._alone, self.frame = True, None
        self._needed = {id(q) for q in (query.queries if isinstance(query, N.And) else [query])}
        leg = self.leg(query)
        if self.frame is None:  # no word of the query is in any document
            self.frame = self.catalog.frame().limit(0)
        kept = self.frame.where(leg.member)
        if leg.score is None:
            return kept.select(self.catalog.id), False
        return kept.select(self.catalog.id, leg.score.cast("double").alias("score")), True

    def leg(self, q: N.Query) -> Leg:
        if isinstance(q, N.Not):
            return self.leg(q.query.negate())
        if isinstance(q, (N.And, N.Or)):
            legs = [self.leg(x) for x in q.queries]
            if not legs:
                raise ValueError("a query without predicates can't run")
            return q.combine(legs) or self.merge(legs, isinstance(q, N.And))
        return self.predicate(q)

    @staticmethod
    def merge(legs: list[Leg], every: bool) -> Leg:
        member = reduce(and_ if every else or_, [x.member for x in legs])
        if all(x.score is None for x in legs):
            return Leg(member)
        scores = [F.lit(SET_WEIGHT) if x.score is None else x.score for x in legs]
        if not every:
            scores = [F.when(x.member, s).otherwise(0.0) for x, s in zip(legs, scores)]
        return Leg(member, reduce(lambda a, b: a + b, scores))

    def predicate(self, q: N.Comparator) -> Leg:
        if isinstance(q, (N.NotEq, N.NotAny, N.NotAll, N.NotContains, N.NotInRange)):
            holds = self.predicate(q.negate()).member
            if isinstance(q.index, TextIndex):
                return Leg(q.index.universe() & ~holds)
            return Leg(q.index.universe() & (F.col(q.index.column).isNull() | ~holds))  # a form that reaches the scan
        if isinstance(q.index, TextIndex):
            if not isinstance(q, (N.Eq, N.Contains)):
                raise TypeError(f"a text index has no {type(q).__name__}")
            return self.text(q.index, q.value, id(q) in self._needed)
        if isinstance(q, N.Contains):
            if not isinstance(q.index, KeywordIndex):
                raise TypeError("only text and keyword indexes have Contains")
            return Leg(self.keyword(N.Eq(q.index, q.value)))
        # NULL where the document has no value, as a filter wants it: bare comparisons are pushed to the scan
        return Leg(self.keyword(q) if isinstance(q.index, KeywordIndex) else self.field(q))

    def field(self, q: N.Comparator) -> Column:
        c, v = F.col(q.index.column), q.value
        if isinstance(q, N.InRange):
            low, high = v
            parts = []
            if low is not None:
                parts.append(c > F.lit(low) if q.low_exclusive else c >= F.lit(low))
            if high is not None:
                parts.append(c < F.lit(high) if q.high_exclusive else c <= F.lit(high))
            return reduce(and_, parts, c.isNotNull())
        if isinstance(q, N.Any_):
            v = [x for x in v if x is not None]
            return c.isin(*v) if v else F.lit(False)
        if v is None:
            raise ValueError("no document's value equals None")
        for kind, holds in ((N.Eq, c == F.lit(v)), (N.Gt, c > F.lit(v)), (N.Ge, c >= F.lit(v)), (N.Lt, c < F.lit(v)), (N.Le, c <= F.lit(v))):
            if isinstance(q, kind):
                return holds
        raise TypeError(f"a field index has no {type(q).__name__}")

    def keyword(self, q: N.Comparator) -> Column:
        c, terms = F.col(q.index.column), q.index.terms(q.value)
        if not isinstance(q, (N.Eq, N.Any_, N.All)):
            raise TypeError(f"a keyword index has no {type(q).__name__}")
        if not terms:
            return F.lit(False)
        has = [F.array_contains(c, F.lit(t)) for t in terms]
        return reduce(or_ if isinstance(q, N.Any_) else and_, has)

    # text

    def text(self, index: TextIndex, query: str, needed: bool = False) -> Leg:
        tree = Q.TextParser(index.analyzer).parse(query)
        ranked = [w for t in Q.query_terms(tree) for w in index.analyzer.terms(t)]
        words = {*ranked, *self._words(tree, index)}
        n_docs, total, holding = index.kept.statistics(words) if index.kept is not None else self.statistics(index, words)
        mean = total / n_docs if n_docs else 0.0
        if index.kept is not None:
            rows: Rows = self._kept_rows(index, tree, [w for w in sorted(set(self._words(tree, index))) if holding.get(w)], needed)
        else:
            rows = self._derived_rows(index, tree)
        leg = self._text_leg(tree, index, n_docs, mean, holding, rows)
        weight = index.ranker.query_weight([idf(n_docs, holding[w]) for w in ranked if holding.get(w)]) or 1.0
        return Leg(leg.member, leg.score / F.lit(float(weight)))

    def statistics(self, index: TextIndex, words: Iterable[str]) -> tuple[int, int, dict[str, int]]:
        """Indexed documents, their words, and how many documents hold each query word; over all documents, before any filter."""
        words = sorted(set(words))
        c = Derived("n", {w: i for i, w in enumerate(words)}, {})
        row = (
            c.derive(self.catalog.frame(), index.column)
            .agg(F.count("n_len").alias("n"), F.coalesce(F.sum("n_len"), F.lit(0)).alias("total"), *[F.count_if(F.col(f"n_tf_{i}") > 0).alias(f"f{i}") for i in range(len(words))])
            .first()
        )
        return row["n"], row["total"], {w: row[f"f{i}"] for i, w in enumerate(words)}

    def _column(self, kind: str) -> str:
        self._joined += 1
        return f"_{kind}_{self._joined}"

    def _words(self, node: Any, index: TextIndex) -> list[str]:
        if isinstance(node, Q.Word):
            return [node.word]
        if isinstance(node, Q.Phrase):
            return index.analyzer.terms(" ".join(node.words))
        if isinstance(node, Q.Glob):
            return []
        if isinstance(node, Q.Without):
            return self._words(node.node, index)
        return [w for n in node.nodes for w in self._words(n, index)]

    def _derived_rows(self, index: TextIndex, tree: Any) -> Derived:
        """Give the frame what the query asks of each document's words."""
        words = sorted(set(self._words(tree, index)))
        phrases = dict.fromkeys(p for n in self._nodes(tree) if isinstance(n, Q.Phrase) if (p := tuple(index.analyzer.terms(" ".join(n.words)))))
        rows = Derived(self._column("derived"), {w: i for i, w in enumerate(words)}, {p: i for i, p in enumerate(phrases)}, index.ranker.needs_norm)
        if words:
            self.frame = rows.derive(self.frame, index.column)
        return rows

    def _kept_rows(self, index: TextIndex, tree: Any, words: list[str], needed: bool) -> "Kept":
        """Join the kept rows of these words to the frame, a row for each document."""
        k = self._column("kept")
        at = {w: i for i, w in enumerate(words)}
        if words:
            phrased = {w for n in self._nodes(tree) if isinstance(n, Q.Phrase) for w in index.analyzer.terms(" ".join(n.words))}
            found = index.kept.postings(words)
            ident = self.catalog.id
            if len(words) == 1:
                found = found.select(ident, F.col("length").alias(f"{k}_len"), F.col("norm").alias(f"{k}_norm"), F.col("tf").alias(f"{k}_tf_0"), *([F.col("places").alias(f"{k}_at_0")] if phrased else []))
            else:
                of = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"{k}_tf_{i}") for w, i in at.items()]
                of += [F.first(F.when(F.col("term") == w, F.col("places")), True).alias(f"{k}_at_{at[w]}") for w in sorted(phrased) if w in at]
                found = found.groupBy(ident).agg(F.max("length").alias(f"{k}_len"), F.max("norm").alias(f"{k}_norm"), *of)
            self._attach(found, needed and not any(isinstance(n, Q.Glob) for n in self._nodes(tree)))
        return Kept(k, at)

    def _attach(self, found: DataFrame, needed: bool = False) -> None:
        if not self._alone:
            self.frame = self.frame.join(found, self.catalog.id, "inner" if needed else "left")
        else:
            self.frame = found if self.frame is None else self.frame.join(found, self.catalog.id, "outer")

    def _nodes(self, node: Any) -> list[Any]:
        below = [node.node] if isinstance(node, Q.Without) else getattr(node, "nodes", [])
        return [node, *[x for n in below for x in self._nodes(n)]]

    def _text_leg(self, node: Any, index: TextIndex, n_docs: int, mean: float, holding: dict[str, int], rows: "Rows") -> Leg:
        inner = [index, n_docs, mean, holding, rows]
        nothing = Leg(F.lit(False), F.lit(0.0))

        def score(word: str) -> Column:
            return index.ranker.term_score(rows.times(word), rows.length(), rows.norm(), idf(n_docs, holding[word]), mean)

        if isinstance(node, Q.Word):
            if not holding.get(node.word):
                return nothing
            return Leg(rows.holds(node.word), score(node.word))
        if isinstance(node, Q.Phrase):
            words = index.analyzer.terms(" ".join(node.words))
            if not words or not all(holding.get(w) for w in words):
                return nothing
            return Leg(rows.in_a_row(words), reduce(lambda a, b: a + b, [score(w) for w in words]))
        if isinstance(node, Q.Glob):
            return self._glob_leg(node, index, n_docs, mean)
        if isinstance(node, Q.Without):
            raise QueryError("a negated word needs another beside it")
        if isinstance(node, Q.AnyOf):
            return self.merge([self._text_leg(x, *inner) for x in node.nodes], False)
        wanted = self.merge([self._text_leg(x, *inner) for x in node.nodes if not isinstance(x, Q.Without)], True)
        for x in node.nodes:
            if isinstance(x, Q.Without):
                wanted = Leg(wanted.member & ~self._text_leg(x.node, *inner).member, wanted.score)
        return wanted

    def _glob_leg(self, node: Q.Glob, index: TextIndex, n_docs: int, mean: float) -> Leg:
        """Scores of all words that match, summed."""
        prefix = glob_prefix(node.pattern)
        if not prefix:
            raise QueryError(f"{node.pattern!r} begins with a wildcard")
        ident, name = self.catalog.id, self._column("glob")
        if index.kept is not None:
            if not index.kept.state["segments"]:
                return Leg(F.lit(False), F.lit(0.0))
            found = index.kept.matching(prefix, glob_pattern(node.pattern)).withColumnRenamed("length", "_len")
        else:
            found = self.catalog.frame().select(ident, F.size(index.column).alias("_len"), F.explode(index.column).alias("term"))
            found = found.where(F.col("term").startswith(prefix) & F.col("term").rlike(glob_pattern(node.pattern)))
            found = found.groupBy(ident, "_len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
            df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            found = found.join(df, "term")
            if index.ranker.needs_norm:
                found = found.join(index.norms(), ident)
        weight = F.log(1.0 + F.lit(float(n_docs)) / F.col("df"))
        one = index.ranker.term_score(F.col("tf"), F.col("_len"), F.col("norm") if index.ranker.needs_norm else None, weight, mean)
        scores = found.groupBy(ident).agg(F.sum(one).alias(name))
        self._attach(scores)
        return Leg(F.col(name).isNotNull(), F.coalesce(F.col(name), F.lit(0.0)))
