"""Target-distribution importance resampling over hashed n-grams.

Words: texts lower-cased in A-Z, runs of letters a-z, digits and characters beyond ASCII. Features are all runs of 1 to
`order` words joined by a space; a feature's bucket is the crc32 of its bytes modulo `buckets`. From the counts of all
documents (s, S) and of the target texts (t, T) a bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))));
a document's weight is the sum of its features' gains. Gumbel noise that a hash of the id fixes is added, and of the
documents with at least `least_words` words the given share with the highest scores is drawn, without replacement.

Integer word dictionary: texts are worked on in blocks of about `block_bytes`. A block maps its distinct words to ids and
represents n-grams as tuples of ids (an n-gram is the number of the one before it and the id of its last word, one
integer); each distinct tuple's bytes are rebuilt and hashed once, by carrying the crc of the shorter one on, and the
bucket is joined back to the tuple's positions. So every n-gram is hashed once a block, and nothing is shuffled for it.
A text longer than a block is a block of its own, so a task's memory is a small multiple of a block or the longest text.

Distribution: one map writes each document's buckets, two bytes each, to the shared folder. Counts of buckets are added
as arrays of fixed size, one from each task, in two levels; weights are a second map, over the written buckets. The order
of the drawn is not made by one task: scores are dealt to `cells` cells by quantiles, cells are counted, and a row's rank
is its cell's start and its place in the cell. A cell holds about one `cells`-th of the rows, however equal the weights
are, as the noise of equal weights spreads over thousands of values.

Defined results: null and empty texts have no words, no features and weight 0; a null id counts as the empty text in the
noise and comes last among equal scores; repeated rows each count and are drawn one by one; with no documents, or fewer
than 100 / percent long ones, nothing is drawn; empty target texts give t = T = 0; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, summed_counts

# Bytes of words as themselves, upper case as lower case, everything else as a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Dictionary(dict):
    """Word -> id, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def buckets_of(texts: list[bytes], order: int = 3, buckets: int = 10_000) -> list[tuple[int, np.ndarray]]:
    """For each text of a block its number of words and the buckets of all its features, by length, then position."""
    ids = _Dictionary()
    parts = [np.fromiter(map(ids.__getitem__, words(t)), np.int64) for t in texts]
    sizes = [len(p) for p in parts]
    flat = np.concatenate([*parts, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    spaced = [b" " + w for w in ids]
    crcs, tuples = [zlib.crc32(w) for w in ids], flat  # of the distinct n-grams; each position's n-gram
    by_order = [(np.array(crcs, np.int64) % buckets)[tuples]]
    for n in range(2, order + 1):
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)
        # Runs over the end of a text are tuples too, but none of them is a feature or the start of one.
        keys, tuples = np.unique(tuples[: len(whole)] * len(spaced) + flat[n - 1 :], return_inverse=True)
        crcs = [zlib.crc32(spaced[last], crcs[first]) for first, last in zip((keys // max(len(spaced), 1)).tolist(), (keys % max(len(spaced), 1)).tolist(), strict=True)]
        by_order.append(np.where(whole, (np.array(crcs, np.int64) % buckets)[tuples] if len(keys) else 0, -1))
    out, at = [], 0
    for size in sizes:
        out.append((size, np.concatenate([found[at : at + size - n] for n, found in enumerate(by_order) if size > n] or [np.zeros(0, np.int64)]).astype(np.uint16)))
        at += size
    return out


def _blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of successive rows, about block_bytes at a time."""
    for batch in batches:
        lengths = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")])
        starts = np.flatnonzero(np.diff(lengths // block_bytes, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.column("id")[a:b], [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")[a:b]]


def hashed_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, buckets: int = 10_000, block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (id, n_words, n_features, found): found is the buckets of all features, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("1 to 65536 buckets")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches, block_bytes):
            rows = buckets_of(texts, order, buckets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()), pa.array([f.tobytes() for _, f in rows], pa.binary())], ["id", "n_words", "n_features", "found"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, found binary")


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows each bucket holds."""
    return summed_counts(features.select("found"), lambda batch: sum((np.bincount(np.frombuffer(f.as_buffer(), np.uint16), minlength=buckets) for f in batch.column("found")), np.zeros(buckets, np.int64)), buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratios of the smoothed shares, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray):
    @F.arrow_udf("long")
    def run(found: pa.Array) -> pa.Array:
        return pa.array([int(gain[np.frombuffer(f.as_buffer(), np.uint16)].sum()) for f in found], pa.int64())

    return run


def noise(id_column, seed: int = 42):
    """Gumbel noise, thousandfold and rounded down, fixed by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn_ranks(rows: DataFrame, take: int, cells: int = 256) -> DataFrame:
    """rows (.., id, n_features, score, fit) with rank: 1 to take for the best that are fit, null for all others.

    Cells are made by approximate quantiles of the score; any bounds give the same ranks, as cells follow the order.
    """
    bounds = rows.where("fit").agg(F.percentile_approx("score", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10_000).alias("b")).first()["b"] if take else None
    none = F.lit(None).cast("long").alias("rank")
    if not bounds:
        return rows.select("*", none)
    bounds = sorted(set(bounds), reverse=True)
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("score")))
    celled = rows.withColumn("cell", F.when(F.col("fit"), cell))
    counts = {r["cell"]: r["n"] for r in celled.where("fit").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    starts, before = [], 0
    for k in range(len(bounds) + 1):
        starts.append(before)
        before += counts.get(k, 0)
    last = max(k for k, s in enumerate(starts) if s < take)
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), F.asc_nulls_last("id"), "n_features"))
    inside = F.coalesce(F.col("cell") <= last, F.lit(False))
    rank = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("cell")) + place
    ranked = celled.where(inside).select("*", rank.alias("place")).select(*rows.columns, F.when(F.col("place") <= take, F.col("place")).alias("rank"))
    return ranked.unionByName(celled.where(~inside).select(*rows.columns, none))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, order: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Rows (id, n_features, weight, score, rank) of every row of df; rank is null for the rows that are not drawn."""
    features = materialize(hashed_features(df, id_col, text_col, order, buckets), "features")
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text_col}`").alias("text")), "id", "text", order, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    weighed = features.select("id", "n_features", _weigher(gain)("found").alias("weight"), (F.col("n_words") >= least_words).alias("fit"))
    rows = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    take = percent * rows.where("fit").count() // 100
    return drawn_ranks(rows, take).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
