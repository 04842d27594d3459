"""Layered filters and search modes as predicates."""

from __future__ import annotations

import dataclasses
import functools
import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import translate
from ..functions.text import fuzzy_match


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class Condition:
    """A row of the advanced filter; `join` says how it is added to the rows above it."""

    column: str
    op: str
    value: Any = ""
    join: str = "AND"

    def predicate(self) -> Column:
        x, v = text_of(self.column), str(self.value)
        low, want = F.lower(x), F.lit(v.lower())
        if self.op in ("greater than", "less than"):
            number = x.try_cast("double")
            compare = operator.gt if self.op == "greater than" else operator.lt
            try:
                return F.coalesce(compare(number, F.lit(float(v))), F.lit(False))
            except ValueError:
                return compare(low, want)
        return {
            "equals": lambda: low == want, "not equals": lambda: low != want, "contains": lambda: low.contains(want), "not contains": lambda: ~low.contains(want), "starts with": lambda: low.startswith(want),
            "ends with": lambda: low.endswith(want), "is empty": lambda: F.trim(x) == "", "is not empty": lambda: F.trim(x) != "", "regex": lambda: x.rlike(translate(v)),
        }[self.op]()


def advanced(conditions: Sequence[Condition]) -> Column:
    """Conditions folded strictly from left to right."""
    out = F.lit(True)
    for k, c in enumerate(conditions):
        p = c.predicate()
        out = p if not k else (out | p) if c.join.upper() == "OR" else (out & p)
    return out


def contains_text(name: str, value: str) -> Column:
    return F.lower(text_of(name)).contains(value.lower())


def search(columns: Sequence[str], term: str, mode: str = "mixed", threshold: float = 0.6) -> Column:
    """Predicate of a search over columns: like, fts, mixed (fts or like), fuzzy or regex."""
    if mode == "like":
        return functools.reduce(operator.or_, [contains_text(c, term) for c in columns])
    if mode == "regex":
        pattern = translate(term)
        return functools.reduce(operator.or_, [text_of(c).rlike(pattern) for c in columns])
    if mode == "fuzzy":
        return functools.reduce(operator.or_, [fuzzy_match(text_of(c), term, threshold) for c in columns])
    if mode == "fts":
        return full_text(columns, term)
    if mode == "mixed":
        return search(columns, term, "fts") | search(columns, term.replace('"', "").rstrip("*"), "like")
    raise ValueError(f"search mode {mode}")


_LETTER = r"[\p{L}\p{N}]"


def full_text_terms(term: str) -> list[tuple[list[str], bool]]:
    """(words, prefix) of each term: "quoted" ones and the others, cut into words as texts are; prefix: it ends in `*`."""
    found = []
    for quoted, plain in re.findall(r'"([^"]*)"?|([^\s"]+)', term.lower()):
        words = re.findall(r"[^\W_]+", quoted or plain)
        if words:
            found.append((words, plain.endswith("*")))
    return found


def _words_in(text: Column, words: Sequence[str], prefix: bool) -> Column:
    """Whether these words stand one after the other in a lower-case text; the last one may go on if it is a prefix.

    Each word is looked for as plain text first, so the pattern only sees texts that hold them all.
    """
    pattern = f"(?<!{_LETTER})" + r"[^\p{L}\p{N}]+".join(words) + ("" if prefix else f"(?!{_LETTER})")
    return functools.reduce(operator.and_, [*[text.contains(w) for w in words], text.rlike(pattern)])


def full_text(columns: Sequence[str], term: str) -> Column:
    """Rows in which every term stands in some column; a term with punctuation (cmd.exe) is a phrase of its words."""
    terms = full_text_terms(term)
    if not terms:
        return F.lit(False)
    texts = [F.lower(text_of(c)) for c in columns]
    each = [functools.reduce(operator.or_, [_words_in(t, words, prefix) for t in texts]) for words, prefix in terms]
    return functools.reduce(operator.and_, each)


@dataclass
class QuerySpec:
    """The filters of a view; parts that are off are not in the plan."""

    text: dict[str, str] = field(default_factory=dict)
    checked: dict[str, Sequence] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    conditions: Sequence[Condition] = ()
    term: str = ""
    mode: str = "mixed"
    search_columns: Sequence[str] | None = None
    disabled: Sequence[str] = ()
    search_off: bool = False

    def predicate(self, df: DataFrame) -> Column:
        parts = [contains_text(c, v) for c, v in self.text.items() if c not in self.disabled]
        parts += [col(c).isin(list(v)) for c, v in self.checked.items() if c not in self.disabled]
        parts += [col(c).between(a, b) for c, (a, b) in self.ranges.items() if c not in self.disabled]
        if self.conditions:
            parts.append(advanced([c for c in self.conditions if c.column not in self.disabled]))
        if self.term and not self.search_off:
            parts.append(search(self.search_columns or [c for c, t in df.dtypes if t == "string"], self.term, self.mode))
        return functools.reduce(operator.and_, parts, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))

    def with_value(self, column: str, value: Any, keep: bool = True) -> QuerySpec:
        """The view filtered in (keep) or out by one cell's value."""
        if keep:
            return dataclasses.replace(self, checked={**self.checked, column: [value]})
        return dataclasses.replace(self, conditions=[*self.conditions, Condition(column, "not equals", value)])

    def signature(self) -> str:
        return repr(self)


class View:
    """A timeline with the totals of its filters and its last searches kept.

    A search's rows are persisted for the next pages and counts; the least recently used of more than `searches` go.
    """

    def __init__(self, df: DataFrame, searches: int = 4):
        self.df, self.searches = df, searches
        self._rows: dict[str, DataFrame] = {}
        self._totals: dict[str, int] = {}

    def rows(self, spec: QuerySpec) -> DataFrame:
        key = spec.signature()
        found = self._rows.pop(key, None)
        if found is None:
            found = spec.apply(self.df)
            if spec.term and not spec.search_off:
                found = found.persist()
        if found.is_cached:
            self._rows[key] = found
            while len(self._rows) > self.searches:
                self._rows.pop(next(iter(self._rows))).unpersist()
        return found

    def total(self, spec: QuerySpec) -> int:
        """The number of rows of a view, counted once for each set of filters."""
        key = spec.signature()
        if key not in self._totals:
            self._totals[key] = self.rows(spec).count()
        return self._totals[key]


def pivot_window(df: DataFrame, ts_col: str, at: Column, minutes: int) -> DataFrame:
    """Rows within minutes of an instant, both ends included."""
    step = F.make_interval(mins=F.lit(minutes))
    return df.where(col(ts_col).between(at - step, at + step))


def search_counts(timelines: dict[str, DataFrame], term: str, mode: str = "mixed") -> DataFrame:
    """Hits of a term in each open timeline: one job."""
    each = [QuerySpec(term=term, mode=mode).apply(df).agg(F.count(F.lit(1)).alias("hits")).select(F.lit(name).alias("timeline"), "hits") for name, df in timelines.items()]
    return functools.reduce(DataFrame.unionByName, each)
