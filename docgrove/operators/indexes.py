"""Index specifications: how a document's value becomes a column, and the predicates an index offers.

An index holds no data. It names a column (or column expression, or a function
of the documents) whose NULL means that a document has no value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Analyzer
from ..functions.ranking import Okapi
from ..sources.postings import PostingStore
from . import nodes as N


class Index:
    """What all kinds share. A catalog sets ``name`` and ``catalog``."""

    def __init__(self, discriminator: str | Column | Callable[[DataFrame], Column]) -> None:
        if not (isinstance(discriminator, (str, Column)) or callable(discriminator)):
            raise ValueError("a discriminator is a column, its name, or a function of the documents")
        self.discriminator = discriminator
        self.name: str | None = None
        self.catalog: Any = None

    def raw(self, documents: DataFrame) -> Column:
        d = self.discriminator
        if isinstance(d, str):
            return documents[d] if d in documents.columns else F.col(d)
        return d if isinstance(d, Column) else d(documents)

    def derived(self, documents: DataFrame) -> Column:
        """The index column."""
        kind = documents.select(self.raw(documents).alias("v")).schema["v"].dataType
        self.check_type(kind)
        return self.value(self.raw(documents), kind)

    def check_type(self, kind: T.DataType) -> None:
        if isinstance(kind, (T.StructType, T.MapType)):
            raise ValueError(f"{kind.simpleString()} can't be indexed")

    def value(self, c: Column, kind: T.DataType) -> Column:
        return c

    @property
    def column(self) -> str:
        return "ix_" + self.name.replace(".", "__")

    def universe(self) -> Column:
        """Documents that the index was told about."""
        return F.lit(True)

    def indexed_column(self) -> Column:
        return F.col(self.column).isNotNull()

    def changed(self, ids: DataFrame, rows: DataFrame | None) -> None:
        """Documents were replaced by rows, or deleted; a derived column follows by itself."""

    # statistics and enumeration

    def _frame(self) -> DataFrame:
        return self.catalog.frame()

    def docids(self) -> DataFrame:
        return self._frame().where(self.universe()).select(self.catalog.id)

    def indexed(self) -> DataFrame:
        return self._frame().where(self.indexed_column() & self.universe()).select(self.catalog.id)

    def not_indexed(self) -> DataFrame:
        return self._frame().where(F.col(self.column).isNull()).select(self.catalog.id)

    def docids_count(self) -> int:
        return self.docids().count()

    def indexed_count(self) -> int:
        return self.indexed().count()

    def not_indexed_count(self) -> int:
        return self.not_indexed().count()

    def document_repr(self, docid: int) -> str | None:
        row = self._frame().where(F.col(self.catalog.id) == docid).select(self.column).first()
        return None if row is None or row[0] is None else repr(row[0])

    def flush(self, *args: Any, **kwargs: Any) -> None:
        """Forget what was cached of the documents."""
        self.catalog.refresh()

    def eq(self, value: Any) -> N.Query:
        return N.Eq(self, value)

    def noteq(self, value: Any) -> N.Query:
        return N.NotEq(self, value)


class FieldIndex(Index):
    """One orderable value for each document."""

    def check_type(self, kind: T.DataType) -> None:
        super().check_type(kind)
        if isinstance(kind, T.ArrayType):
            raise ValueError("a field index takes single values; use a keyword index for arrays")

    def gt(self, value: Any) -> N.Query:
        return N.Gt(self, value)

    def ge(self, value: Any) -> N.Query:
        return N.Ge(self, value)

    def lt(self, value: Any) -> N.Query:
        return N.Lt(self, value)

    def le(self, value: Any) -> N.Query:
        return N.Le(self, value)

    def any(self, values: Iterable | N.Name) -> N.Query:
        return N.Any_(self, values)

    def notany(self, values: Iterable | N.Name) -> N.Query:
        return N.NotAny(self, values)

    def inrange(self, low: Any, high: Any, low_exclusive: bool = False, high_exclusive: bool = False) -> N.Query:
        return N.InRange(self, (low, high), low_exclusive, high_exclusive)

    def notinrange(self, low: Any, high: Any, low_exclusive: bool = False, high_exclusive: bool = False) -> N.Query:
        return N.NotInRange(self, (low, high), low_exclusive, high_exclusive)

    def unique_values(self) -> DataFrame:
        return self._frame().where(F.col(self.column).isNotNull()).select(F.col(self.column).alias("value")).distinct().orderBy("value")

    def word_count(self) -> int:
        return self._frame().agg(F.count_distinct(self.column)).first()[0]


class KeywordIndex(Index):
    """A set of keywords for each document; an empty set is unknown to the index, NULL is without a value.

    ``normalize`` maps a keyword column, ``normalize_value`` a keyword of a query.
    """

    def __init__(self, discriminator: Any, normalize: Callable[[Column], Column] | None = None, normalize_value: Callable[[Any], Any] | None = None) -> None:
        super().__init__(discriminator)
        self.normalize, self.normalize_value = normalize, normalize_value

    def check_type(self, kind: T.DataType) -> None:
        if not isinstance(kind, T.ArrayType):
            raise TypeError("a keyword index takes arrays")
        super().check_type(kind.elementType)

    def value(self, c: Column, kind: T.DataType) -> Column:
        words = F.filter(c, lambda w: w.isNotNull())
        return F.array_distinct(F.transform(words, self.normalize) if self.normalize else words)

    def terms(self, values: Any) -> list:
        found = [values] if isinstance(values, (str, bytes)) or not hasattr(values, "__iter__") else list(values)
        return [self.normalize_value(v) for v in found] if self.normalize_value else found

    def universe(self) -> Column:
        return F.col(self.column).isNull() | (F.size(self.column) > 0)

    def any(self, values: Any) -> N.Query:
        return N.Any_(self, values)

    def notany(self, values: Any) -> N.Query:
        return N.NotAny(self, values)

    def all(self, values: Any) -> N.Query:
        return N.All(self, values)

    def notall(self, values: Any) -> N.Query:
        return N.NotAll(self, values)

    def optimize(self) -> None:
        """Nothing to compact: postings aren't materialised."""

    def unique_values(self) -> DataFrame:
        return self._frame().select(F.explode(self.column).alias("value")).distinct().orderBy("value")

    def word_count(self) -> int:
        return self.unique_values().count()


class FacetIndex(KeywordIndex):
    """Keywords out of a declared vocabulary of paths like ``a:b:c``; a document carries its paths' ancestors too."""

    def __init__(self, discriminator: Any, facets: Iterable[str]) -> None:
        super().__init__(discriminator)
        self.facets = sorted(set(facets))

    def value(self, c: Column, kind: T.DataType) -> Column:
        def ancestors(path: Column) -> Column:
            parts = F.split(path, ":")
            return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))

        expanded = F.flatten(F.transform(F.filter(c, lambda w: w.isNotNull()), ancestors))
        return F.array_intersect(expanded, F.array(*[F.lit(f) for f in self.facets]).cast("array<string>"))

    def counts(self, result: Any = None, omit_facets: Iterable[str] = ()) -> DataFrame:
        """(facet, n): how many of the result's documents carry each facet.

        Facets in ``omit_facets`` and their ancestors are left out, as are those of no document.
        """
        omit = set()
        for path in omit_facets:
            parts = path.split(":")
            omit.update(":".join(parts[: i + 1]) for i in range(len(parts)))
        frame = self._frame()
        if result is not None:
            ids = result.ids() if hasattr(result, "ids") else result
            frame = frame.join(ids.select(self.catalog.id).distinct(), self.catalog.id, "left_semi")
        rows = frame.select(F.explode(self.column).alias("facet"))
        if omit:
            rows = rows.where(~F.col("facet").isin(*sorted(omit)))
        return rows.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


class TextIndex(Index):
    """Analysed words for each document (texts or arrays of texts), searched by text queries and ranked."""

    def __init__(self, discriminator: Any, analyzer: Analyzer | None = None, ranker: Any = None) -> None:
        super().__init__(discriminator)
        self.analyzer, self.ranker = analyzer or Analyzer(), ranker or Okapi()
        self.kept: PostingStore | None = None

    def store(self, path: str) -> "TextIndex":
        """Write the index's postings to a folder; from now on queries read them and maintenance keeps them up to date."""
        kept = self._folder(path)
        self.kept = kept.write(self.analysed(kept.spread(self.catalog.documents)))
        return self

    def _folder(self, path: str) -> PostingStore:
        docs = self.catalog.documents
        return PostingStore(docs.sparkSession, path, self.catalog.id, docs.schema[self.catalog.id].dataType.simpleString())

    def open(self, path: str) -> "TextIndex":
        """Use postings that were stored before, of the same documents and analyzer."""
        self.kept = self._folder(path)
        if not self.kept.state["segments"]:
            raise ValueError(f"no postings in {path}")
        return self

    def optimize(self) -> None:
        """Merge what maintenance added to the stored postings."""
        if self.kept is not None:
            self.kept.compact()

    def analysed(self, rows: DataFrame) -> DataFrame:
        """(id, terms) of documents."""
        return rows.select(self.catalog.id, self.derived(rows).alias("terms"))

    def changed(self, ids: DataFrame, rows: DataFrame | None) -> None:
        """Bring stored postings up to date with documents replaced or deleted."""
        if self.kept is not None:
            self.kept.update(ids, None if rows is None else self.analysed(rows))

    def check_type(self, kind: T.DataType) -> None:
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StringType):
            raise ValueError("a text index takes texts or arrays of texts")

    def value(self, c: Column, kind: T.DataType) -> Column:
        return self.analyzer.column(c, isinstance(kind, T.ArrayType))

    def contains(self, query: Any) -> N.Query:
        return N.Contains(self, query)

    def notcontains(self, query: Any) -> N.Query:
        return N.NotContains(self, query)

    eq, noteq = contains, notcontains

    def check_query(self, query: str) -> bool:
        from ..errors import ParseError
        from ..functions.textquery import TextParser

        try:
            TextParser(self.analyzer).parse(query)
        except ParseError:
            return False
        return True

    def postings(self) -> DataFrame:
        """(id, term, tf)."""
        return self._frame().select(self.catalog.id, F.explode(self.column).alias("term")).groupBy(self.catalog.id, "term").agg(F.count(F.lit(1)).alias("tf"))

    def term_stats(self) -> DataFrame:
        """(term, df, cf): documents that hold a term, and its places."""
        return self.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def norms(self) -> DataFrame:
        """(id, norm): the length of each document's vector of log-scaled frequencies."""
        return self.postings().groupBy(self.catalog.id).agg(F.sqrt(F.sum(F.pow(1.0 + F.log("tf"), 2.0))).alias("norm"))

    def lexicon(self) -> DataFrame:
        """(wid, word): every word of the vocabulary with an id that stays the word's own, whatever else is indexed."""
        return self.vocabulary().select(F.xxhash64("term").alias("wid"), F.col("term").alias("word"))

    def get_wid(self, word: str) -> int:
        """The id of a word, 0 for one that no document holds."""
        row = self.lexicon().where(F.col("word") == word).first()
        return 0 if row is None else row["wid"]

    def get_word(self, wid: int) -> str | None:
        row = self.lexicon().where(F.col("wid") == wid).first()
        return None if row is None else row["word"]

    def get_words(self, docid: int) -> list[str]:
        """A document's words in order; none if it isn't indexed."""
        row = self._frame().where(F.col(self.catalog.id) == docid).select(self.column).first()
        return list(row[0]) if row is not None and row[0] is not None else []

    def has_doc(self, docid: int) -> bool:
        return bool(self.indexed().where(F.col(self.catalog.id) == docid).limit(1).count())

    def vocabulary(self) -> DataFrame:
        return self._frame().select(F.explode(self.column).alias("term")).distinct()

    def word_count(self) -> int:
        return self.vocabulary().count()

    def document_repr(self, docid: int) -> str | None:
        row = self._frame().where(F.col(self.catalog.id) == docid).select(F.array_join(self.column, " ")).first()
        return None if row is None else row[0]
