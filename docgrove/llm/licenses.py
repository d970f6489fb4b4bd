r"""License scan by template-markup matching.

Base phrases are found where their words stand consecutively. Beyond them,
license templates in SPDX-style markup are compiled to token automata:
``<<beginOptional>>...<<endOptional>>`` regions may be left out and
``<<var;name=...;min=A;max=B>>`` regions match A to B arbitrary words, and
``<<var;name=...;match=a|b>>`` one of these words. A text is
accepted for a template where, from some word on, all mandatory words stand
exactly, in order, with nothing between them but what the markup allows. Templates
of whole licenses run to the end of their disclaimers, so a license that only
begins like another isn't taken for it; at ``<<textMayEnd>>`` (MIT) a text that is
cut off there is accepted, one that goes on must go on as the template does.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased, so
punctuation and line breaks don't matter. All words of a batch are found and
hashed at once; phrases and template heads are compared as hashes and verified
as bytes, and an automaton runs only from places where a template's mandatory
head stands, so the cost is one pass over the bytes.

Scale: no shuffle; a map over the scan, in bounded chunks of whole documents.

Defined cases: a null or empty text has no words, no labels (empty strings) and
score 0; places of several phrases all count; repeated rows are scored alike; an
empty table gives no rows; other columns pass through, the result's own names
replaced.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .common import unused

BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_BSD = (
    "Redistribution and use in source and<<beginOptional>>/or<<endOptional>> binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name=bullet1;min=0;max=1>> Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. <<var;name=bullet2;min=0;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following <<var;name=disclaimer;match=disclaimer|disclaimers>> in the documentation and/or other materials provided with the distribution."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY <<var;name=holder;min=1;max=20>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;min=1;max=20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

#: (label, template): short notices and short licenses, in SPDX template markup.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<endOptional>>"),
    ("gpl-3.0", "<<beginOptional>>This work is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, <<beginOptional>>either <<endOptional>>version 3<<beginOptional>>.0<<endOptional>>"),
    ("gpl-2.0", "<<beginOptional>>This work is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, <<beginOptional>>either <<endOptional>>version 2<<beginOptional>>.0<<endOptional>>"),
    ("gpl-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl-2.1", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mit", "Released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit", "Licensed under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("cc-by-nc-4.0", "Licensed under <<beginOptional>>a <<endOptional>>CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under <<beginOptional>>a <<endOptional>>CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under <<beginOptional>>a <<endOptional>>CC BY 4.0"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;min=1;max=8>> (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies "
        "or substantial portions of <<var;name=work;min=1;max=4>>. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED<<textMayEnd>>, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;min=1;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=holder;min=1;max=20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=liable;min=1;max=20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    ("bsd-3-clause", f"{_BSD} <<var;name=bullet3;min=0;max=1>> Neither the name of <<var;name=organisation;min=1;max=20>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD} {_BSD_DISCLAIMER}"),
)

#: Whole licenses, from their first clause to the end of their terms; ``license_texts`` holds them as published.
WHOLE = ("apache-2.0", "cc0-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0")


def whole_license(label: str) -> str:
    """A whole license as a template: its heading, the first line, may be left out."""
    heading, _, body = pkgutil.get_data(__package__, f"license_texts/{label}.txt").decode().partition("\n")
    return f"<<beginOptional>>{heading}<<endOptional>> {body}" if heading.isupper() else f"{heading} {body}"


_MARK = re.compile(r"<<(beginOptional|endOptional|textMayEnd|var[^>]*)>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def words_of(text: str) -> list[str]:
    return _WORD.findall(ascii_lower(text))


class Automaton:
    """A template as an automaton over words.

    ``steps[state]`` maps a word to the next state; ``any_word[state]`` and
    ``free[state]`` list the states reached by any word and by none.
    """

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        self.steps: list[dict[str, int]] = [{}]
        self.any_word: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[str] = []
        self.may_end: set[int] = set()  # states accepted where the text ends there
        at, opened, last = 0, [], 0
        parts = _MARK.split(template)
        for i, part in enumerate(parts):
            if i % 2 == 0:
                for w in words_of(part):
                    nxt = self._state()
                    self.steps[at][w] = nxt
                    at = nxt
                    if not opened:
                        self.mandatory.append(w)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                nxt = self._state()
                self.free[at].append(nxt)
                self.free[opened.pop()].append(nxt)
                at = nxt
            elif part == "textMayEnd":
                self.may_end.add(at)
            else:
                found = dict(x.split("=", 1) for x in part.split(";")[1:])
                if "match" in found:
                    nxt = self._state()
                    for w in found["match"].split("|"):
                        self.steps[at][ascii_lower(w)] = nxt
                    at = nxt
                    continue
                low, high = int(found.get("min", 0)), int(found.get("max", 10))
                for k in range(high):
                    nxt = self._state()
                    self.any_word[at].append(nxt)
                    if k >= low:
                        self.free[at].append(nxt)
                    at = nxt
        if opened or not self.mandatory:
            raise ValueError("a template needs mandatory words and closed regions")
        self.final = at
        # the first two consecutive mandatory words, and the words that may stand before them
        self.head, self.head_state, self.lead = self._head(parts)

    def _state(self) -> int:
        self.steps.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _head(self, parts: list[str]) -> tuple[tuple[str, ...], int, int]:
        """Mandatory words to look for, and the most words that the markup allows before them."""
        lead, depth = 0, 0
        for i, part in enumerate(parts):
            if i % 2 == 0:
                w = words_of(part)
                if depth == 0 and w:
                    return tuple(w[:2]), 0, lead
                lead += len(w)
            elif part == "beginOptional":
                depth += 1
            elif part == "endOptional":
                depth -= 1
            elif part == "textMayEnd":
                continue
            else:
                found = dict(x.split("=", 1) for x in part.split(";")[1:])
                lead += 1 if "match" in found else int(found.get("max", 10))
        raise ValueError("no mandatory words")

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def accepts(self, words: Iterator[str]) -> int:
        """Words of the shortest accepted run from here, or 0."""
        states, n = self.closure({0}), 0
        for n, w in enumerate(words, 1):
            nxt = set()
            for s in states:
                if (t := self.steps[s].get(w)) is not None:
                    nxt.add(t)
                nxt.update(self.any_word[s])
            if not nxt:
                return 0
            states = self.closure(nxt)
            if self.final in states:
                return n
        return n if states & self.may_end else 0


AUTOMATA = tuple(Automaton(label, t) for label, t in (*TEMPLATES, *((x, whole_license(x)) for x in WHOLE)))


def _hash_word(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return S.hash_spans(b, np.array([0]), np.array([len(b)]), lower=True)[0]


def find(hashes: np.ndarray, doc: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    """Word positions (in the chunk) where these words may stand consecutively in one document."""
    k = len(words)
    at = np.flatnonzero(hashes == _hash_word(words[0]))
    at = at[at + k <= len(hashes)]
    for i in range(1, k):
        at = at[hashes[at + i] == _hash_word(words[i])]
    return at[doc[at] == doc[at + k - 1]]


def scan(data: np.ndarray, offsets: np.ndarray, phrases=BASE_PHRASES, automata=AUTOMATA) -> dict[str, list]:
    """The scan's columns for one chunk of documents."""
    n = len(offsets) - 1
    starts, ends, counts = S.alnum_words(data, offsets)
    h = S.hash_spans(data, starts, ends, lower=True)
    doc = np.repeat(np.arange(n), counts)
    first_of = np.concatenate([[0], np.cumsum(counts)])

    def word(i: int) -> str:
        return data[starts[i] : ends[i]].tobytes().lower().decode()

    n_base = np.zeros(n, np.int64)
    first, last = [None] * n, [None] * n
    base: list[set[str]] = [set() for _ in range(n)]
    found: list[set[str]] = [set() for _ in range(n)]
    score = np.zeros(n)
    for phrase, label in phrases:
        want = tuple(phrase.split(" "))
        for i in find(h, doc, want).tolist():
            if all(word(i + k) == w for k, w in enumerate(want)):
                d = int(doc[i])
                p = i - int(first_of[d])
                n_base[d] += 1
                first[d] = p if first[d] is None else min(first[d], p)
                last[d] = p if last[d] is None else max(last[d], p)
                base[d].add(label)
                score[d] = max(score[d], 0.5)
    for a in automata:
        for i in find(h, doc, a.head).tolist():
            d = int(doc[i])
            if a.label in found[d] and score[d] == 1.0:
                continue
            lo, hi = max(int(first_of[d]), i - a.lead), int(first_of[d + 1])
            if any(a.accepts(word(k) for k in range(j, hi)) for j in range(i, lo - 1, -1)):
                found[d].add(a.label)
                score[d] = 1.0
    return {
        "n_words": counts,
        "n_base": n_base,
        "first_word": first,
        "last_word": last,
        "base_labels": [",".join(sorted(b)) for b in base],
        "labels": [",".join(sorted(b | f)) for b, f in zip(base, found)],
        "score": score,
    }


_FIELDS = [("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]


def _run(text_at: int, carried: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = S.flat(batch.column(text_at))
            parts = [scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in S.chunks(offsets)]
            out = [pa.concat_arrays([pa.array(p[name], kind) for p in parts]) if parts else pa.array([], kind) for name, _, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *out], [*batch.schema.names[:carried], *[f[0] for f in _FIELDS]])

    return run


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), then n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a template is accepted, 0.5 where only base phrases stand, else 0.
    """
    own = {f[0] for f in _FIELDS}
    carried = [c for c in (docs.columns if keep is None else keep) if c not in own]
    rows = docs.select(*carried, F.col(text).cast("string").alias(unused(docs, "scanned")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t, _ in _FIELDS]])
    return rows.mapInArrow(_run(len(carried), len(carried)), schema)
