"""The catalog: documents, their indexes, queries and maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import nodes as N
from .operators.indexes import FieldIndex, Index, KeywordIndex, TextIndex
from .plans.compiler import Compiler
from .plans.expressions import parse_query
from .results import ResultSet
from .sources.tables import delete_rows, one_each, upsert_rows


class Catalog:
    """Named indexes over one table of documents.

    Indexes are declared, not filled: each derives its column from the documents
    when a query runs. ``cache()`` keeps the derived columns for many queries.
    """

    def __init__(self, documents: DataFrame, id_col: str = "docid", resolver: Any = None, results: Callable[..., ResultSet] = ResultSet) -> None:
        """``results`` makes the result of a query from (catalog, rows, scored, resolver=)."""
        if not isinstance(documents.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            raise ValueError(f"{id_col} isn't an integer column")
        self.documents, self.id, self.resolver, self.results = documents, id_col, resolver, results
        self._indexes: dict[str, Index] = {}
        self._frame: DataFrame | None = None
        self._cached = False

    # indexes

    def __setitem__(self, name: str, index: Index) -> None:
        index.name, index.catalog = name, self
        self._indexes[name] = index
        self.refresh()

    def __getitem__(self, name: str) -> Index:
        return self._indexes[name]

    def __contains__(self, name: object) -> bool:
        return name in self._indexes

    def __iter__(self) -> Iterator[str]:
        return iter(self._indexes)

    def __len__(self) -> int:
        return len(self._indexes)

    def frame(self) -> DataFrame:
        """The id and one column for each index."""
        if self._frame is None:
            self._frame = self.documents.select(self.id, *[i.derived(self.documents).alias(i.column) for i in self._indexes.values()])
            if self._cached:
                self._frame.persist()
        return self._frame

    def cache(self) -> "Catalog":
        """Keep derived columns (analysed texts above all) in memory and on disk from the next query on."""
        self._cached = True
        self.refresh()
        return self

    def refresh(self) -> None:
        if self._frame is not None and self._cached:
            self._frame.unpersist()
        self._frame = None

    flush = refresh

    # maintenance

    def _replace(self, documents: DataFrame, ids: DataFrame, rows: DataFrame | None = None) -> "Catalog":
        self.documents = documents
        self.refresh()
        for index in self._indexes.values():
            index.changed(ids, rows)
        return self

    def index_docs(self, rows: DataFrame, order: str | None = None) -> "Catalog":
        """Insert documents; those that are there already are replaced. Of rows that repeat an id the one greatest by ``order`` counts."""
        rows = one_each(rows, self.id, order).select(*self.documents.columns)
        return self._replace(upsert_rows(self.documents, rows, self.id, unique=True), rows, rows)

    reindex_docs = index_docs

    def unindex_docs(self, ids: DataFrame) -> "Catalog":
        """Delete documents by id; unknown ids are ignored."""
        return self._replace(delete_rows(self.documents, ids, self.id), ids)

    def reset(self) -> "Catalog":
        none = self.documents.limit(0)
        for index in self._indexes.values():
            if isinstance(index, TextIndex) and index.kept is not None:
                index.kept.write(index.analysed(none))
        self.documents = none
        self.refresh()
        return self

    def _one(self, docid: int, values: dict) -> DataFrame:
        if not isinstance(docid, int) or isinstance(docid, bool):
            raise ValueError("a docid is an integer")
        return self.documents.sparkSession.createDataFrame([{**values, self.id: docid}], self.documents.schema)

    def index_doc(self, docid: int, values: dict) -> "Catalog":
        row = self._one(docid, values)
        return self._replace(upsert_rows(self.documents, row, self.id, unique=True), row, row)

    reindex_doc = index_doc

    def unindex_doc(self, docid: int) -> "Catalog":
        if not isinstance(docid, int) or isinstance(docid, bool):
            raise ValueError("a docid is an integer")
        one = self.documents.sparkSession.createDataFrame([(docid,)], f"{self.id} {self.documents.schema[self.id].dataType.simpleString()}")
        return self._replace(self.documents.where(F.col(self.id) != docid), one)

    # queries

    def parse(self, text: str) -> N.Query:
        return parse_query(text, self)

    def execute(self, query: str | N.Query, names: dict | None = None, resolver: Any = None) -> ResultSet:
        if isinstance(query, str):
            query = self.parse(query)
        rows, scored = Compiler(self).run(query.bound(names))
        return self.results(self, rows, scored, resolver=resolver or self.resolver)

    def query(self, query: str | N.Query, sort_index: str | None = None, limit: int | None = None, sort_type: str | None = None, reverse: bool = False, names: dict | None = None) -> tuple[int, ResultSet]:
        """The number of documents found, and they. A limit applies only with a sort index."""
        found = self.execute(query, names)
        if sort_index is not None:
            found = found.sort(self[sort_index], reverse, limit, sort_type, raise_unsortable=False)
        return len(found), found

    __call__ = query

    def sort(self, ids: DataFrame, sort_index: str | None = None, limit: int | None = None, sort_type: str | None = None, reverse: bool = False) -> ResultSet:
        """Sort ids from elsewhere."""
        found = ResultSet(self, ids.select(self.id), resolver=self.resolver)
        return found if sort_index is None else found.sort(self[sort_index], reverse, limit, sort_type, raise_unsortable=False)

    def search(self, sort_index: str | None = None, reverse: bool = False, limit: int | None = None, sort_type: str | None = None, index_query_order: list[str] | None = None, **terms: Any) -> tuple[int, ResultSet | tuple]:
        """Documents that satisfy a term for each named index.

        Field terms: a pair is an inclusive range, a list any-of, None every
        indexed document, a dict {query, operator} a union or intersection.
        Keyword terms: all of them, or a dict with its operator. Text: a query.
        """
        for name in terms:
            if name not in self:
                raise ValueError(f"no index named {name}")
        if not terms:
            return 0, ()
        wanted = [self._term(self[name], terms[name]) for name in (index_query_order or terms)]
        return self.query(N.And(*wanted) if len(wanted) > 1 else wanted[0], sort_index, limit, sort_type, reverse)

    def _term(self, index: Index, term: Any) -> N.Query:
        if isinstance(index, TextIndex):
            return index.contains(term)
        operator, values = None, term
        if isinstance(term, dict):
            operator, values = term.get("operator", "or"), term["query"]
            if operator not in ("and", "or"):
                raise TypeError(f"no operator {operator!r}")
        if isinstance(index, KeywordIndex):
            return index.any(values) if operator == "or" else index.all(values)
        if operator is None and (values is None or isinstance(values, tuple) and len(values) == 2):
            return index.inrange(*(values or (None, None)))
        several = list(values) if isinstance(values, (list, tuple, set)) else [values]
        if not several:
            return index.any([])
        parts = [self._field_part(index, v) for v in several]
        return parts[0] if len(parts) == 1 else (N.And if operator == "and" else N.Or)(*parts)

    @staticmethod
    def _field_part(index: FieldIndex, value: Any) -> N.Query:
        if isinstance(value, RangeValue):
            return index.inrange(value.start, value.end)
        return index.inrange(None, None) if value is None else index.eq(value)


class RangeValue:
    """An inclusive range among the terms of a search."""

    def __init__(self, start: Any, end: Any) -> None:
        self.start, self.end = start, end
