"""A full-text index: an inverted index with positions, kept as a sorted table.

A posting is (token, id, column, position). Postings are sorted by token, so a search opens the files of its words only;
prefixes are ranges of tokens. Words of a phrase meet where their positions less their places in the phrase are equal;
terms meet by row. Both are one aggregation of the postings read, so a frequent word costs its own postings and no more,
and no task holds a whole list. Texts are cut as full_text() cuts them, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import col, full_text_terms, text_of
from .sorted_table import SortedTable, write_sorted

_LAST = "\U0010ffff"  # after every other character


def postings(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(token, id, column, position) of every word of some columns."""
    words = lambda c: F.filter(F.split(F.lower(text_of(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    texts = F.array(*[F.struct(F.lit(k).alias("column"), words(c).alias("words")) for k, c in enumerate(columns)])
    each = df.select(col(id_col).alias("id"), F.explode(texts).alias("x"))
    return each.select("id", "x.column", F.posexplode("x.words").alias("position", "token")).select("token", "id", "column", "position")


@dataclass(frozen=True)
class TextIndex:
    """An index over the columns of a table."""

    table: SortedTable
    columns: tuple[str, ...]

    def found(self, term: str) -> DataFrame:
        """(id) of the rows in which every term stands in some column; see full_text() for the terms."""
        terms = full_text_terms(term)
        if not terms:
            return self.table.rows().select("id").limit(0)
        if max(len(terms), *(len(words) for words, _ in terms)) > 63:
            raise ValueError("a search has at most 63 terms, and a phrase 63 words")
        asked = [(t, k, w, prefix and k == len(words) - 1) for t, (words, prefix) in enumerate(terms) for k, w in enumerate(words)]
        read = self.table.where_key(*{(w, p): (F.lit(w), F.lit(w + _LAST if p else w)) for _, _, w, p in asked}.values())
        hit = lambda w, p: F.col("token").startswith(w) if p else F.col("token") == w
        places = F.filter(F.array(*[F.when(hit(w, p), F.struct(F.lit(t).alias("term"), F.lit(k).alias("place"))) for t, k, w, p in asked]), lambda x: x.isNotNull())
        placed = read.select("id", "column", "position", F.explode(places).alias("x")).select("id", "column", "x.*", (F.col("position") - F.col("x.place")).alias("start"))
        sizes = F.array(*[F.lit(len(words)) for words, _ in terms])
        # A phrase's places are met once each at its start, so they are bits that add up.
        whole = placed.groupBy("id", "term", "column", "start").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
        full = whole.where(F.bit_count("places") == F.get(sizes, F.col("term")))
        return full.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, term)")).alias("terms")).where(F.bit_count("terms") == len(terms)).select("id")

    def search(self, df: DataFrame, term: str, id_col: str) -> DataFrame:
        """The rows of df that the index finds."""
        ids = self.found(term).withColumnRenamed("id", id_col)
        return df.join(ids, id_col, "left_semi")


def build_index(df: DataFrame, columns: Sequence[str], id_col: str, path: str | None = None, files: int | None = None) -> TextIndex:
    """An index of some columns of df, whose rows id_col tells apart; without a path it goes with the application."""
    return TextIndex(write_sorted(postings(df, columns, id_col), ["token", "id", "column", "position"], path, files), tuple(columns))
