"""Analyzers: text to words, as Spark columns for documents and in Python for query strings.

Every step has both forms, and the two agree. A word is a maximal run of Unicode
letters, digits and underscores. In glob form ``*`` and ``?`` may follow a word's
first character.
"""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
GLOB_WORD = r"[\p{L}\p{N}_]+[\p{L}\p{N}_*?]*"
#: Words too common to be indexed.
STOP_WORDS = tuple("there these their such with will then into this that they and the are for was not but be if of in on no to or as is at it by a".split())
_TAG = r"(?:<[^<>]*>)|(?:&[A-Za-z]+;)"


class Step:
    """A step of an analyzer: ``column`` for documents, ``words`` for query strings, ``glob_words`` where globs must survive."""

    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def words(self, items: list[str]) -> list[str]:
        raise NotImplementedError

    def glob_words(self, items: list[str]) -> list[str]:
        return self.words(items)


class Split(Step):
    """Strings to words. ``lower_first`` and ``strip_markup`` make it fit for HTML."""

    def __init__(self, strip_markup: bool = False) -> None:
        self.strip_markup = strip_markup

    def column(self, c: Column) -> Column:
        if self.strip_markup:
            c = F.regexp_replace(F.lower(c), _TAG, " ")
        return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))

    def _find(self, items: list[str], pattern: str) -> list[str]:
        if self.strip_markup:
            items = [regex.sub(_TAG, " ", x.lower()) for x in items]
        return [w for x in items for w in regex.findall(pattern, x)]

    def words(self, items: list[str]) -> list[str]:
        return self._find(items, WORD)

    def glob_words(self, items: list[str]) -> list[str]:
        return self._find(items, GLOB_WORD)


class Lower(Step):
    def column(self, c: Column) -> Column:
        return F.transform(c, F.lower)

    def words(self, items: list[str]) -> list[str]:
        return [w.lower() for w in items]


class DropWords(Step):
    """Drops stop words before positions are counted; ``single`` also drops one-character words below code point 255."""

    def __init__(self, stop: tuple[str, ...] = STOP_WORDS, single: bool = False) -> None:
        self.stop, self.single = tuple(stop), single

    def column(self, c: Column) -> Column:
        def stays(w: Column) -> Column:
            ok = ~w.isin(*self.stop) if self.stop else F.lit(True)
            return ok & ~((F.length(w) == 1) & (F.ascii(w) < 255)) if self.single else ok

        return F.filter(c, stays)

    def words(self, items: list[str]) -> list[str]:
        return [w for w in items if w not in self.stop and not (self.single and len(w) == 1 and ord(w) < 255)]


class Custom(Step):
    """A step of one's own: a function of columns of word arrays, and its twin on lists."""

    def __init__(self, column: Callable[[Column], Column], words: Callable[[list[str]], list[str]]) -> None:
        self._column, self._words = column, words

    def column(self, c: Column) -> Column:
        return self._column(c)

    def words(self, items: list[str]) -> list[str]:
        return self._words(items)


class Analyzer:
    """A splitter and steps on its words."""

    def __init__(self, *steps: Step) -> None:
        self.steps = steps or (Split(), Lower(), DropWords())

    def column(self, c: Column, many: bool = False) -> Column:
        """Words of a text column, or of an array of texts, whose streams join."""
        split, *rest = self.steps
        out = F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), split.column)) if many else split.column(c)
        for step in rest:
            out = step.column(out)
        return out

    def terms(self, text: str) -> list[str]:
        items = [text]
        for step in self.steps:
            items = step.words(items)
        return items

    def glob_terms(self, text: str) -> list[str]:
        items = [text]
        for step in self.steps:
            items = step.glob_words(items)
        return items


def is_glob(word: str) -> bool:
    return "*" in word or "?" in word


def glob_pattern(word: str) -> str:
    """The anchored regular expression of a glob."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or regex.escape(c) for c in word) + "$"


def glob_prefix(word: str) -> str:
    """What every match begins with."""
    return regex.match(r"[^*?]*", word)[0]


HTML = Analyzer(Split(strip_markup=True), DropWords())
