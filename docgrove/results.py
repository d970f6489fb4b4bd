"""Result sets: lazy, ordered, resolvable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .errors import MultipleResults, NoResults, Unsortable
from .operators.indexes import FieldIndex, TextIndex

OPTIMAL, STABLE, FWSCAN, NBEST, TIMSORT = "optimal", "stable", "fwscan", "nbest", "timsort"
_KINDS = (None, OPTIMAL, STABLE, FWSCAN, NBEST, TIMSORT)


class ResultSet:
    """Documents found, their order, and how to resolve an id.

    The order is a list of sort keys, kept as columns: a later sort puts its key
    before the earlier ones, which is what a stable sort does.
    """

    def __init__(self, catalog: Any, rows: DataFrame, scored: bool = False, order: list[Column] | None = None, resolver: Callable[[int], Any] | None = None, sorted_by: str | None = None, keys: int = 0) -> None:
        self.catalog, self.rows, self.scored = catalog, rows, scored
        self.order = order if order is not None else [F.col(catalog.id).asc()]
        self.resolver, self.sort_type, self._keys = resolver, sorted_by, keys

    def _with(self, rows: DataFrame, order: list[Column], sorted_by: str | None, keys: int) -> "ResultSet":
        return type(self)(self.catalog, rows, self.scored, order, self.resolver, sorted_by, keys)

    # as DataFrames

    def ids(self) -> DataFrame:
        """The ids, unordered."""
        return self.rows.select(self.catalog.id)

    def scores(self) -> DataFrame:
        """(id, score), unordered."""
        if not self.scored:
            raise TypeError("the result has no scores")
        return self.rows.select(self.catalog.id, "score")

    def ordered(self) -> DataFrame:
        """Ids (and scores) in order."""
        out = self.rows.orderBy(*self.order)
        return out.select(self.catalog.id, "score") if self.scored else out.select(self.catalog.id)

    def documents(self) -> DataFrame:
        """The documents' rows, joined back by id, unordered."""
        return self.catalog.documents.join(self.ids(), self.catalog.id, "left_semi")

    # sorting

    def sort(self, index: FieldIndex | TextIndex, reverse: bool = False, limit: int | None = None, sort_type: str | None = None, raise_unsortable: bool = True) -> "ResultSet":
        """Order by an index. A second and later sort is stable.

        Documents without a value are left out; they raise ``Unsortable`` if asked,
        unless a limit is met without them.
        """
        if limit is not None and limit < 1:
            raise ValueError("a limit is at least 1")
        if sort_type not in _KINDS:
            raise ValueError(f"no sort type {sort_type!r}")
        if isinstance(index, TextIndex):
            return self._by_score(reverse, limit)
        if not isinstance(index, FieldIndex):
            raise TypeError("only field and text indexes sort")
        if reverse and sort_type == FWSCAN:
            raise ValueError("a forward scan can't sort in reverse")
        stable = sort_type in (STABLE, TIMSORT) or self.sort_type is not None
        key = f"_key_{self._keys}"
        values = self.catalog.frame().select(self.catalog.id, F.col(index.column).alias(key))
        full = self.rows.join(values, self.catalog.id, "left")
        have = full.where(F.col(key).isNotNull())
        ident = F.col(self.catalog.id)
        if reverse:
            best = not stable and limit is not None and (sort_type == NBEST or limit < 300 or limit > 0.09 * max(self.rows.count(), 1))
            order = [F.col(key).desc(), ident.desc()] if best else [F.col(key).desc(), *self.order]
        else:
            order = [F.col(key).asc(), *(self.order if stable else [ident.asc()])]
        if raise_unsortable and not (limit is not None and have.limit(limit).count() == limit):
            none = full.where(F.col(key).isNull()).select(self.catalog.id)
            missing = [r[0] for r in none.orderBy(self.catalog.id).limit(Unsortable.SHOWN + 1).collect()]
            if missing:
                raise Unsortable(missing[: Unsortable.SHOWN], len(missing) if len(missing) <= Unsortable.SHOWN else none.count())
        out = have.orderBy(*order).limit(limit) if limit is not None else have
        return self._with(out, order, STABLE, self._keys + 1)

    def _by_score(self, reverse: bool, limit: int | None) -> "ResultSet":
        if not self.scored:
            raise TypeError("documents without scores can't be sorted by relevance")
        ident = F.col(self.catalog.id)
        order = [F.col("score").asc(), ident.asc()] if reverse else [F.col("score").desc(), ident.desc()]
        rows = self.rows.orderBy(*order).limit(limit) if limit is not None else self.rows
        return self._with(rows, order, STABLE, self._keys)

    # verbs

    def __len__(self) -> int:
        return self.rows.count()

    def _resolve(self, ids: list[int], resolve: bool) -> list:
        if not resolve:
            return ids
        if self.resolver is not None:
            return [self.resolver(i) for i in ids]
        docs = self.catalog.documents
        found: dict[int, Row] = {r[self.catalog.id]: r for r in docs.where(docs[self.catalog.id].isin(ids)).collect()} if ids else {}
        return [found.get(i) for i in ids]

    def _head(self, n: int) -> list[int]:
        return [r[0] for r in self.rows.orderBy(*self.order).limit(n).select(self.catalog.id).collect()]

    def first(self, resolve: bool = True) -> Any:
        got = self._head(1)
        return self._resolve(got, resolve)[0] if got else None

    def one(self, resolve: bool = True) -> Any:
        got = self._head(2)
        if not got:
            raise NoResults()
        if len(got) > 1:
            raise MultipleResults()
        return self._resolve(got, resolve)[0]

    def all(self, resolve: bool = True) -> Iterator:
        """Ids or documents in order, streamed a partition at a time."""
        if not resolve or self.resolver is not None:
            ids = (r[0] for r in self.ordered().toLocalIterator())
            return ids if not resolve else (self.resolver(i) for i in ids)
        docs = self.catalog.documents
        kept = [c for c in self.rows.columns if c not in docs.columns or c == self.catalog.id]
        return iter(docs.join(self.rows.select(*kept), self.catalog.id).orderBy(*self.order).select(*docs.columns).toLocalIterator())

    def __iter__(self) -> Iterator:
        return self.all()

    def intersect(self, other: "ResultSet | DataFrame") -> "ResultSet":
        """The documents that are also in another result, in this one's order."""
        ids = other.ids() if isinstance(other, ResultSet) else other.select(self.catalog.id)
        return self._with(self.rows.join(ids, self.catalog.id, "left_semi"), self.order, None, self._keys)
