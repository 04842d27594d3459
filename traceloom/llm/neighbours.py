"""Approximate nearest neighbours by additive quantisation, for largest inner product.

Training: on a sample of at most `sample` vectors (the one bounded step; the smallest hashes of the ids), residual
k-means gives `books` full-dimensional codebooks of `size` words, refined by alternating beam-search encoding and a
least-squares update of all codebooks together.
Encoding: of every vector the direction is coded by beam search over the codebooks, and its norm is stored with the code in
double precision, so that vectors of any finite size stand beside each other. Search: codes are held in blocks of about `block_rows` and queries in groups of about `query_rows`, and each
pair of a block and a group is one cogroup, so a task holds one of each however many queries the table has. A lookup
table of inner products of query and codewords scores all codes of a block, the best `shortlist` of each block (so a
fixed share of all rows) are reranked exactly in double precision on the original vectors, which stand beside their
codes, and a block passes on its k + 1 best; those are merged per query. Scores of codes are accumulated in float32 from
the tables, then multiplied by the stored norm in double precision; `measure` may be "ip" or "l2".

Equal vectors are one entry: a class keeps its smallest `k + 1` ids (gathered over salted partial groups), which is all
that the k nearest and the tie rule (smaller id first) can need, so copies cannot crowd a shortlist out.

Defined results: vectors that are null, empty, zero, of another dimension than the most frequent one, or that hold null
or non-finite components take no part, as query or candidate; a query's own row is left out (repeated rows with its id
too); rows that repeat an id with another vector are candidates of their own, so an id may have a rank for each of its
vectors, and as a query it stands for the smallest of them in the order of arrays; ties go to the smaller id; fewer
candidates than k give fewer rows; an inner product that leaves the doubles' range is infinite as it is in doubles, and one
that is not a number there (infinities of both signs) counts as the least; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Quantiser:
    """Codebooks of shape (books, size, dim) and the beam width used for encoding."""

    books: np.ndarray
    beam: int = 8

    def encode(self, x: np.ndarray, rows_at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of reconstruction: beam search for the smallest squared error, some rows at a time."""
        m, size, _ = self.books.shape
        flat = self.books.reshape(m * size, -1)
        norms, gram = (flat**2).sum(1), (flat @ flat.T).reshape(m, size, m, size)
        parts = [self._beam(x[at : at + rows_at_once] @ flat.T, norms, gram) for at in range(0, len(x), rows_at_once)]
        codes = np.concatenate([*parts, np.zeros((0, m), np.uint8)])
        return codes, (self.decode(codes) ** 2).sum(1)

    def _beam(self, dots: np.ndarray, norms: np.ndarray, gram: np.ndarray) -> np.ndarray:
        m, size, n = len(self.books), self.books.shape[1], len(dots)
        codes, cost, rows = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1)), np.arange(n)[:, None]
        for k in range(m):
            own = slice(k * size, (k + 1) * size)
            total = np.zeros((n, codes.shape[1], size))
            for j in range(k):
                total += np.ascontiguousarray(gram[j, :, k])[codes[:, :, j]]
            total *= 2
            total += cost[:, :, None]
            total += (norms[own] - 2 * dots[:, own])[:, None, :]
            total = total.reshape(n, -1)
            width = min(self.beam, total.shape[1])
            best = np.argpartition(total, width - 1, axis=1)[:, :width]
            cost = total[rows, best]
            codes = np.concatenate((codes[rows, best // size], (best % size)[:, :, None]), axis=2)
        return codes[np.arange(n), cost.argmin(1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, k]] for k, book in enumerate(self.books))


def train(x: np.ndarray, books: int, size: int, beam: int, rounds: int = 4, seed: int = 7) -> Quantiser:
    """Codebooks for the rows of x."""
    rng, rest, found = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        center = rest[rng.choice(len(rest), size, replace=len(rest) < size)].copy()
        for _ in range(8):
            near = (((center**2).sum(1)) - 2 * rest @ center.T).argmin(1)
            total = np.bincount(near, minlength=size)
            sums = np.zeros_like(center)
            np.add.at(sums, near, rest)
            center = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], center)
        found.append(center)
        rest = rest - center[(((center**2).sum(1)) - 2 * rest @ center.T).argmin(1)]
    model = Quantiser(np.stack(found), beam)
    for _ in range(rounds):
        codes = model.encode(x, 256)[0].astype(np.int64) + np.arange(books) * size
        counts = np.zeros((books * size, books * size))
        sums = np.zeros((books * size, x.shape[1]))
        for a in range(books):
            np.add.at(sums, codes[:, a], x)
            for b in range(books):
                np.add.at(counts, (codes[:, a], codes[:, b]), 1)
        counts.flat[:: books * size + 1] += 1e-3
        flat = np.linalg.solve(counts, sums + 1e-3 * model.books.reshape(books * size, -1))
        del counts, sums
        model = Quantiser(flat.reshape(books, size, -1), beam)
    return model


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) that take part: v is array<double>."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of norm 1 and the norms, without leaving the range of doubles on the way."""
    largest = np.abs(x).max(1, keepdims=True)
    part = x / largest
    length = np.sqrt((part**2).sum(1, keepdims=True))
    return part / length, np.minimum(largest[:, 0], np.finfo(np.float64).max / length[:, 0]) * length[:, 0]


def _tables(model: Quantiser, queries: np.ndarray) -> np.ndarray:
    """Inner products of queries and codewords, (queries, books, size)."""
    return np.einsum("qd,msd->qms", queries, model.books).astype(np.float32)


_NONE = np.iinfo(np.int64).min  # the second id of a class that has one id only


def _packed(pdf: pd.DataFrame) -> dict[str, bytes]:
    """The columns of a block of vectors as bytes."""
    return {c: pdf[c].to_numpy(np.int64).tobytes() for c in ("name", "id", "second") if c in pdf} | {"v": _stack(pdf["v"]).tobytes()}


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the best scores of a row, ties to the smaller id."""
    if len(scores) > keep:
        least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:keep]]
    return np.arange(len(scores))


def _nearness(cosine: np.ndarray, norm: np.ndarray, length: float) -> np.ndarray:
    """What orders vectors as their distance to a query of the given length does, in units of the largest norm."""
    unit = max(norm.max(), length)
    return 2 * (length / unit) * (norm / unit) * cosine - (norm / unit) ** 2


def _shortlister(model: Quantiser, shortlist: int, keep: int, measure: str, queries_at_once: int = 256):
    books, _, dim = model.books.shape

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qids, packed in zip(queries["id"], queries["v"], strict=True):
            numbers = np.frombuffer(qids, np.int64)
            asked = np.frombuffer(packed, np.float64).reshape(len(numbers), dim)
            for block in codes.itertuples(index=False):
                name, first, second = (np.frombuffer(x, np.int64) for x in (block.name, block.id, block.second))
                norm, vectors = np.frombuffer(block.norms, np.float64), np.frombuffer(block.v, np.float64).reshape(-1, dim)
                flat = np.ascontiguousarray(np.frombuffer(block.codes, np.uint8).reshape(-1, books).T).astype(np.int64)
                for at in range(0, len(asked), queries_at_once):
                    part = asked[at : at + queries_at_once]
                    units, lengths = directions(part)
                    for q, v, length, lut in zip(numbers[at : at + queries_at_once].tolist(), part, lengths, _tables(model, units), strict=True):
                        score = lut[0][flat[0]]
                        for k in range(1, books):
                            score += lut[k][flat[k]]
                        score = score * norm if measure == "ip" else _nearness(score, norm, length)
                        # A class that is the query's own row alone takes no part; another one's first id may be its own.
                        own = first == q
                        ids, fits = np.where(own, second, first), np.flatnonzero(~(own & (second == _NONE)))
                        near = fits[_best(score[fits], ids[fits], shortlist)]
                        with np.errstate(over="ignore", invalid="ignore"):
                            exact = (vectors[near] * v).sum(1) if measure == "ip" else -((vectors[near] - v) ** 2).sum(1)
                        exact[np.isnan(exact)] = -np.inf
                        best = _best(exact, ids[near], keep)
                        out.append((q, name[near][best].tolist(), ids[near][best].tolist(), exact[best].tolist()))
        return pd.DataFrame(out, columns=["query_id", "names", "ids", "scores"])

    return run


def _trained(reps: DataFrame, sample: int, books: int, size: int, beam: int) -> Quantiser:
    rows = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    x = directions(_stack(rows["v"]))[0]
    return train(x, books, min(size, max(2, len(x))), beam)


def search(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, measure: str = "ip", shortlist: int = 768, sample: int = 8192, books: int = 16, size: int = 128, beam: int = 4, block_rows: int = 16_384, query_rows: int = 2048
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of df that is_query holds for, its k nearest other rows.

    sample: vectors that codebooks are trained on, at most. shortlist: classes of equal vectors
    reranked for a query in each block of about block_rows classes.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dim = sizes["n"]
    rows = rows.where(F.size("v") == dim)
    asked = df.where(F.coalesce(is_query, F.lit(False)))
    queries = usable(asked, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    # Classes of equal vectors, each with its smallest k + 1 ids and named by the smallest.
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(smallest(F.collect_list("id")).alias("ids"))
    classes = salted.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    second = F.coalesce(F.try_element_at("ids", F.lit(2)), F.lit(int(_NONE))).alias("second")
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("name"), F.col("ids")[0].alias("id"), second, "v", "ids"), "classes")
    model = _trained(classes, sample, books, size, beam)

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        units, norms = directions(_stack(pdf["v"]))
        return pd.DataFrame([_packed(pdf) | {"block": int(pdf["block"].iloc[0]), "codes": model.encode(units)[0].tobytes(), "norms": norms.tobytes()}])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_packed(pdf) | {"part": int(pdf["part"].iloc[0])}])

    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = materialize(queries, "queries")
    blocks, parts = max(1, -(-classes.count() // block_rows)), max(1, -(-queries.count() // query_rows))
    codes = classes.select("name", "id", "second", "v", of(blocks).alias("block")).groupBy("block").applyInPandas(code, "block int, name binary, id binary, second binary, codes binary, norms binary, v binary")
    packed = queries.select("id", "v", of(parts).alias("part")).groupBy("part").applyInPandas(pack, "part int, id binary, v binary")
    tiles = packed.withColumn("block", every(blocks)).groupBy("block", "part").cogroup(codes.withColumn("part", every(parts)).groupBy("block", "part"))
    short = tiles.applyInPandas(_shortlister(model, shortlist, k, measure), "query_id long, names array<long>, ids array<long>, scores array<double>")
    found = short.select("query_id", F.explode(F.arrays_zip("names", "ids", "scores")).alias("c")).select("query_id", F.col("c.names").alias("name"), F.col("c.ids").alias("id"), F.col("c.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    # Every class that is left holds another id than the query's, so k classes with k + 1 ids each are enough.
    near = found.withColumn("place", rank).where(F.col("place") <= k).select("query_id", "name", "score")
    ranked = near.join(classes.select("name", "ids"), "name").select("query_id", F.explode("ids").alias("id"), "score").where("id != query_id")
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def exact_search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> pd.DataFrame:
    """Brute force on the driver, for small tables and tests."""
    rows = usable(df, id_col, vector_col).toPandas()
    asked = usable(df.where(is_query), id_col, vector_col).toPandas()
    x, ids, out = _stack(rows["v"]), rows["id"].to_numpy(), []
    for q, v in zip(asked["id"], asked["v"], strict=True):
        with np.errstate(over="ignore", invalid="ignore"):
            score = (x * np.asarray(v, float)).sum(1)  # row by row, so equal vectors tie exactly
        score[np.isnan(score)] = -np.inf
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out += [(q, r, ids[i], score[i]) for r, i in enumerate(order, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", id_col, "score"])
