"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Index: items are cut into words (lower case, ASCII punctuation is white space); a posting holds the BM25 impact of a word
in an item divided by the item's score for itself, so 1 means every word of the item is in the passage. Items are sorted
by length and cut into blocks, each with its largest impact per word.

Query: texts are cut into windows of `2 * L` words every `L` words (L: the longest item of the index), so a verbatim
item lies whole in one window. First all windows of a batch get upper bounds from the block maxima (a sum over their
distinct words), refined inside the blocks that reach the threshold; the few windows that are left run block-max WAND
over the posting lists, which returns every item above the threshold. Retrieved pairs are verified: of the five-word
shingles of the item, or of its question part, at least 0.8 stand in the window, and of the words of both its question and
its answer part at least half stand there in order. So a question without its answer is no leak, and one whose answer was
reworded in part is.

The index is broadcast inside the task closures in shards of at most `shard_items` items, so what is sent at a time is
bounded whatever the size of the benchmark; texts are read once per shard.

Defined results: null and empty texts match nothing; null and wordless items are left out, and items of under five
words count as one shingle; items of over `longest` words stay whole, in indexes of their own for every doubling of
the length, so they widen no other item's windows; a null id is carried along; repeated rows and repeated items match each; empty tables match nothing; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_BOUND_COLUMNS = 32  # of the table of upper bounds; more items make its blocks larger
_FINE_CELLS = 1 << 24  # of the finer table


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: lower case, cut at ASCII white space and punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def shingles(words: list[bytes], width: int = 5) -> list[tuple[bytes, ...]]:
    return [tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []


@dataclass(repr=False)
class Index:
    """Posting lists of (item, impact) by word, with block maxima; items are numbered by length."""

    ids: list
    words: list[list[bytes]]
    answers: list[int]  # where each item's answer part starts
    block: int = 8
    number: dict[bytes, int] = field(default_factory=dict)
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    maxima: list[dict[int, float]] = field(default_factory=list)
    top: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        n, mean = len(self.ids), sum(map(len, self.words)) / max(1, len(self.ids))
        df = Counter(w for item in self.words for w in set(item))
        self.number = {w: k for k, w in enumerate(sorted(df))}
        self.postings = [[] for _ in df]
        for item, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                self.postings[self.number[w]].append((item, x / whole))
        for posting in self.postings:
            best: dict[int, float] = {}
            for item, x in posting:
                best[item // self.block] = max(best.get(item // self.block, 0), x)
            self.maxima.append(best)
            self.top.append(max(best.values()))
        blocks = -(-n // self.block)
        self.wide = max(1, -(-blocks // _BOUND_COLUMNS))
        self.bounds = np.zeros((len(self.postings) + 1, -(-blocks // self.wide)), np.float32)
        for term, best in enumerate(self.maxima):
            for b, x in best.items():
                self.bounds[term, b // self.wide] = max(self.bounds[term, b // self.wide], x)
        # The same for parts of each column: single items, or larger parts where the table would be too large.
        per, columns = self.wide * self.block, self.bounds.shape[1]
        self.parts = max(1, min(per, _FINE_CELLS // (len(self.bounds) * columns)))
        size = -(-per // self.parts)
        self.fine = np.zeros((len(self.bounds), columns, self.parts), np.float32)
        for term, posting in enumerate(self.postings):
            for item, x in posting:
                cell = self.fine[term, item // per]
                cell[item % per // size] = max(cell[item % per // size], x)
        self.longest = max(map(len, self.words), default=0)
        self.shingles = [shingles(w) for w in self.words]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with a score of at least the threshold, for distinct terms."""
        lists = [[self.postings[t], 0, t] for t in terms]
        heap = [(p[0][0], k) for k, (p, _, _) in enumerate(lists)]
        heapq.heapify(heap)
        found, least = [], threshold - 1e-9

        def advance(k: int, to: int) -> None:
            posting, at, _ = lists[k]
            while at < len(posting) and posting[at][0] < to:
                at += 1
            lists[k][1] = at
            if at < len(posting):
                heapq.heappush(heap, (posting[at][0], k))

        while heap:
            cursors, total, pivot = [], 0.0, None
            while heap:
                item, k = heapq.heappop(heap)
                cursors.append((item, k))
                total += self.top[lists[k][2]]
                if total >= least:
                    pivot = item
                    break
            if pivot is None:
                break
            while heap and heap[0][0] == pivot:
                cursors.append(heapq.heappop(heap))
            inside = pivot // self.block
            if sum(self.maxima[lists[k][2]].get(inside, 0.0) for _, k in cursors) < least:
                # No item up to the block's end, or up to the next cursor, can reach the threshold.
                to = min([(inside + 1) * self.block, *([heap[0][0]] if heap else [])])
                to = max(to, pivot + 1)
            elif cursors[0][0] == pivot:
                score = sum(lists[k][0][lists[k][1]][1] for _, k in cursors)
                if score >= least:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for item, k in cursors:
                if item < to:
                    advance(k, to)
                else:
                    heapq.heappush(heap, (item, k))
        return found

    def reached(self, term: np.ndarray, edges: np.ndarray, threshold: float) -> np.ndarray:
        """Which queries some item may reach the threshold for; query k has the distinct terms from edges[k] on.

        Block maxima are summed over a query's terms, and only in blocks whose sum reaches the threshold are those of
        smaller parts (single items, unless the index is very large).
        """
        out, least = np.zeros(len(edges), bool), threshold - 1e-4
        query, column = np.nonzero(np.add.reduceat(self.bounds[term], edges, axis=0) >= least)
        sizes = np.diff(edges, append=len(term))[query]
        for at in range(0, len(query), 4096):
            q, n = query[at : at + 4096], sizes[at : at + 4096]
            firsts = np.cumsum(n) - n
            rows = np.arange(n.sum()) + np.repeat(edges[q] - firsts, n)
            best = np.add.reduceat(self.fine[term[rows], np.repeat(column[at : at + 4096], n)], firsts, axis=0).max(axis=1)
            out[q[best >= least]] = True
        return out

    def verify(self, item: int, window: list[bytes]) -> tuple[float, float, float]:
        """Shares of the shingles of the item or its question part, whichever is more, and of the words of its question and
        its answer part in order, in the window."""
        cut, words = self.answers[item], self.words[item]
        width = min(5, len(words))
        there = set(shingles(window, width))
        here = [s in there for s in self.shingles[item]]
        first = here[: max(0, cut - width + 1)]
        share = max(sum(here) / len(here), sum(first) / len(first) if first else 0.0)
        return share, in_order(words[:cut], window), in_order(words[cut:], window)


def in_order(part: list[bytes], window: list[bytes]) -> float:
    """Length of the longest common subsequence as a share of the part; 1 for an empty part."""
    if not part:
        return 1.0
    # Bit-parallel: a zero in `row` is a word of the part by which the subsequence grows.
    at: dict[bytes, int] = {}
    for k, p in enumerate(part):
        at[p] = at.get(p, 0) | 1 << k
    full = (1 << len(part)) - 1
    row = full
    for w in window:
        if w in at:
            both = row & at[w]
            row = (row + both | row - both) & full
    return (len(part) - row.bit_count()) / len(part)


def answer_start(text: str, words: list[bytes]) -> int:
    """Where the answer part starts: after the last question mark, else after three quarters of the words."""
    head, mark, tail = text.rpartition("?")
    return len(words_of(head)) if mark and words_of(head) and words_of(tail) else len(words) * 3 // 4


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_items: int = 20_000, longest: int = 512) -> Iterator[Index]:
    """Indexes over bounded shards of the items, by class of length; one shard's items at a time are on the driver."""
    count = items.where(F.col(text_col).isNotNull()).count()
    shards = max(1, -(-count // shard_items))
    spread = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for shard in range(shards):
        groups: dict[int, list] = {}
        for r in spread.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard).collect():
            words = words_of(r["text"])
            if words:
                groups.setdefault(((len(words) - 1) // longest).bit_length(), []).append((r["id"], words, answer_start(r["text"], words)))
        for _, rows in sorted(groups.items()):
            rows.sort(key=lambda x: len(x[1]))
            yield Index([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows])


def _matches(index: Index, words: list[bytes], windows: list[int], terms: np.ndarray, threshold: float) -> list[tuple[int, int, float, float, float, float]]:
    out: dict[int, tuple] = {}
    for start in windows:
        stop = start + 2 * index.longest
        distinct = np.unique(terms[start:stop])
        for item, score in index.search(distinct[distinct < len(index.postings)].tolist(), threshold):
            share, question, answer = index.verify(item, words[start:stop])
            if share >= 0.8 and question >= 0.5 and answer >= 0.5 and (item not in out or share > out[item][3]):
                out[item] = (start, item, score, share, question, answer)
    return list(out.values())


def _scan(index: Index, threshold: float):
    """A function from texts to lists of matches, one list per text."""
    none, step = len(index.postings), max(1, index.longest)

    def run(texts: list[str | None]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        at, get = 0, index.number.get
        while at < len(texts):
            first, held, part, starts, owners = at, 0, [], [], []
            while at < len(texts) and held < 400_000:
                words = words_of(texts[at])
                terms = np.fromiter((get(w, none) for w in words), np.int32, len(words))
                part.append((words, terms))
                begin = range(0, max(1, len(words) - step), step)
                starts.extend(begin)
                owners.extend([at] * len(begin))
                held += len(words)
                at += 1
            # Distinct terms of each window, as (window, term) codes, then the sum of their block maxima.
            codes = []
            for k, (owner, start) in enumerate(zip(owners, starts, strict=True)):
                seen = part[owner - first][1][start : start + 2 * step]
                codes.append(seen[seen < none].astype(np.int64) + k * (none + 1))
            flat = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
            if not len(flat):
                continue
            window, term = flat // (none + 1), flat % (none + 1)
            edges = np.flatnonzero(np.diff(window, prepend=-1))
            hit: dict[int, list[int]] = {}
            for k in window[edges[index.reached(term, edges, threshold)]].tolist():
                hit.setdefault(owners[k], []).append(starts[k])
            for owner, windows in hit.items():
                out[owner] = _matches(index, *[part[owner - first][0], windows, part[owner - first][1]], threshold)
        return out

    return run


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows (id, item, window, score, overlap, question_overlap, answer_overlap) of every verified pair."""
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    columns = [id_col, item_col, "window", "score", "overlap", "question_overlap", "answer_overlap"]
    schema = f"id {kind}, item {item_kind}, window long, score double, overlap double, question_overlap double, answer_overlap double"
    rows, out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for index in build_indexes(items, item_col, item_text_col):

        def run(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            scan = _scan(index, threshold)
            for pdf in batches:
                found = [(i, index.ids[m[1]], m[0], *m[2:]) for i, ms in zip(pdf["id"], scan(pdf["text"].tolist()), strict=True) for m in ms]
                yield pd.DataFrame(found, columns=["id", "item", *columns[2:]])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _leaks(index: Index, threshold: float):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(m) for m in _scan(index, threshold)(texts.tolist())], dtype=bool)

    return leaks


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, with all their columns, in whose text no item was verified."""
    for index in build_indexes(items):
        df = df.where(~_leaks(index, threshold)(df[text_col]))
    return df
