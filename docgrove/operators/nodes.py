"""Query nodes: immutable trees of predicates over indexes.

Negation is two-valued: a negated predicate holds for every document that its
index was told about and that the predicate doesn't hold for, those without a
value included. The negation of an ordering is the opposite ordering, which
leaves documents without a value out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Name:
    """A value bound when the query runs."""

    name: str

    def __str__(self) -> str:
        return self.name


def bind(value: Any, names: dict | None) -> Any:
    """Names replaced by their values, also within lists and tuples; a missing one is a NameError."""
    if isinstance(value, Name):
        if value.name not in (names or {}):
            raise NameError(f"no value given for {value.name}")
        return names[value.name]
    if isinstance(value, (list, tuple)):
        return type(value)(bind(v, names) for v in value)
    return value


class Query:
    """What trees are made of."""

    def __and__(self, other: "Query") -> "And":
        self._check(other)
        return And(self, other)

    def __or__(self, other: "Query") -> "Or":
        self._check(other)
        return Or(self, other)

    @staticmethod
    def _check(other: object) -> None:
        if not isinstance(other, Query):
            raise TypeError(f"a query is needed, not {type(other).__name__}")

    def negate(self) -> "Query":
        raise NotImplementedError

    def bound(self, names: dict | None) -> "Query":
        raise NotImplementedError

    def children(self) -> tuple["Query", ...]:
        return ()

    def combine(self, legs: list) -> Any:
        """A hook for nodes that merge their legs in a way of their own; None takes the usual one."""
        return None

    def tree(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + str(self), *[c.tree(depth + 1) for c in self.children()]])

    def print_tree(self) -> None:
        print(self.tree())

    def leaves(self) -> list["Comparator"]:
        return [x for c in self.children() for x in c.leaves()]


@dataclass(frozen=True)
class Comparator(Query):
    """A predicate over one index."""

    index: Any
    value: Any
    opposite = ""
    sign = ""

    def negate(self) -> Query:
        return _BY_NAME[self.opposite](*[getattr(self, f.name) for f in fields(self)])

    def bound(self, names: dict | None) -> Query:
        return replace(self, value=bind(self.value, names))

    def leaves(self) -> list["Comparator"]:
        return [self]

    def execute(self, **options: Any):
        return self.index.catalog.execute(self, **options)

    def __str__(self) -> str:
        return f"{getattr(self.index, 'name', self.index)} {self.sign} {self.value!r}"


def _comparator(name: str, opposite: str, sign: str, doc: str) -> type:
    return dataclass(frozen=True)(type(name, (Comparator,), {"opposite": opposite, "sign": sign, "__doc__": doc, "__module__": __name__}))


Eq = _comparator("Eq", "NotEq", "==", "The value equals; a keyword is there; a text matches.")
NotEq = _comparator("NotEq", "Eq", "!=", "Not Eq, documents without a value included.")
Gt = _comparator("Gt", "Le", ">", "Above.")
Ge = _comparator("Ge", "Lt", ">=", "At or above.")
Lt = _comparator("Lt", "Ge", "<", "Below.")
Le = _comparator("Le", "Gt", "<=", "At or below.")
Any_ = _comparator("Any_", "NotAny", "in any", "One of the values.")
NotAny = _comparator("NotAny", "Any_", "not in any", "None of the values.")
All = _comparator("All", "NotAll", "in all", "All of the keywords; of an empty list, nothing.")
NotAll = _comparator("NotAll", "All", "not in all", "Not all of the keywords.")
Contains = _comparator("Contains", "NotContains", "contains", "The text matches a text query; scored.")
NotContains = _comparator("NotContains", "Contains", "does not contain", "The text doesn't match; not scored.")


@dataclass(frozen=True)
class InRange(Comparator):
    """Between two bounds, each in- or exclusive; None leaves an end open."""

    value: Any = None  # (low, high)
    low_exclusive: bool = False
    high_exclusive: bool = False
    opposite = "NotInRange"

    def __str__(self) -> str:
        low, high = self.value
        return f"{low!r} {'<' if self.low_exclusive else '<='} {getattr(self.index, 'name', self.index)} {'<' if self.high_exclusive else '<='} {high!r}"


@dataclass(frozen=True)
class NotInRange(InRange):
    """Outside the bounds, or without a value."""

    opposite = "InRange"

    def __str__(self) -> str:
        return f"not({super().__str__()})"


_BY_NAME = {c.__name__: c for c in (Eq, NotEq, Gt, Ge, Lt, Le, Any_, NotAny, All, NotAll, Contains, NotContains, InRange, NotInRange)}
#: The same under the names that list predicates are often asked for.
In, NotIn = Any_, NotAny


@dataclass(frozen=True, init=False)
class _Many(Query):
    queries: tuple[Query, ...] = field(default=())

    def __init__(self, *queries: Query) -> None:
        flat: list[Query] = []
        for q in queries:
            self._check(q)
            flat.extend(q.queries if type(q) is type(self) else [q])
        object.__setattr__(self, "queries", tuple(flat))

    def children(self) -> tuple[Query, ...]:
        return self.queries

    def bound(self, names: dict | None) -> Query:
        return type(self)(*[q.bound(names) for q in self.queries])

    def execute(self, **options: Any):
        leaves = self.leaves()
        if not leaves:
            raise ValueError("a query without predicates can't run")
        return leaves[0].index.catalog.execute(self, **options)

    def __str__(self) -> str:
        return type(self).__name__


class And(_Many):
    """All of them."""

    def negate(self) -> Query:
        return Or(*[q.negate() for q in self.queries])


class Or(_Many):
    """Any of them."""

    def negate(self) -> Query:
        return And(*[q.negate() for q in self.queries])


@dataclass(frozen=True)
class Not(Query):
    """The negation, pushed down to predicates."""

    query: Query

    def negate(self) -> Query:
        return self.query

    def children(self) -> tuple[Query, ...]:
        return (self.query,)

    def bound(self, names: dict | None) -> Query:
        return Not(self.query.bound(names))

    def execute(self, **options: Any):
        return self.leaves()[0].index.catalog.execute(self, **options)

    def __str__(self) -> str:
        return "Not"
