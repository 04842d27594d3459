"""Hard-negative mining by a Voronoi-partition distributed kNN join.

For each anchor its `positives` first other rows of its own label by inner product, and for each of those the first
`negatives` rows of other labels whose score is between `low` and `high` percent of the positive's. Vectors are quantised
first (floor(scale * x)), so scores are exact integers; ties go to the smaller id.

Geometry: vectors are divided by the largest norm and get one more coordinate, sqrt(1 - |u|^2) (0 for anchors), so a
larger inner product is a smaller distance. Every row belongs to the nearest of a bounded number of pivots, and rows are
sorted by pivot and distance and packed in blocks of at most `block_rows`, each with its pivot and its least and largest
distance to it. Anchors form groups of about `anchor_rows` in each cell.

The join, once for positives and once for negatives: (1) home: groups meet the blocks of their own cell, which gives an
upper bound of the k-th distance of every anchor. (2) Away: of each cell the driver holds three numbers (the anchors'
largest distance to the pivot, their largest bound, and for negatives the least distance that a score may have). By the
triangle inequality a block can serve a group only if |d(p, q) - r| - U <= bound for some r of the block's distances;
blocks are replicated only to the groups of such cells, and there only scores that beat an anchor's bound are passed on.
Blocks and groups meet in tiles of bounded size; each gives exact local results, merged by anchor.

Where vectors are spread so evenly that no bound excludes anything (as in many dimensions without clusters), every block
goes to every group: anchors times rows of work, in tiles. Cells and labels that hold a large share of the rows are many
blocks, as packing follows a sort by range.

Defined results: rows with a null id, label or vector, of another dimension than the most frequent one (empty ones too),
or with a component that is null, not finite or at least 1e300 when scaled take no part; zero vectors do; products beyond 64
bits count as the largest or smallest 64-bit number; other rows are rows with another id than the anchor's; rows that repeat
an id are candidates of their own, as an anchor an id stands for its smallest label and vector; positives with a negative
score have no negatives; fewer rows than asked for give fewer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

LIMIT = (1 << 63) - 1  # scores beyond it count as it


@dataclass(frozen=True)
class Cells:
    """Pivots in scaled and augmented space; the factor that scales vectors down."""

    pivots: np.ndarray
    norm: float

    @classmethod
    def of(cls, vectors: np.ndarray, norm: float) -> Cells:
        return cls(augmented(vectors / norm), norm)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (points**2).sum(1)[:, None] - 2 * points @ self.pivots.T + (self.pivots**2).sum(1)
        cell = square.argmin(1)
        return cell.astype(np.int32), np.sqrt(((points - self.pivots[cell]) ** 2).sum(1))

    def between(self) -> np.ndarray:
        return np.sqrt(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2))


def augmented(u: np.ndarray) -> np.ndarray:
    """Scaled vectors with the coordinate that gives all of them norm 1."""
    return np.concatenate((u, np.sqrt(np.maximum(0, 1 - (u**2).sum(1)))[:, None]), axis=1)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integral vectors as 64-bit integers, exact or at the limits."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(x).max(initial=0) < 1 << 53:
        return (a @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(x).T, -LIMIT, LIMIT).astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, scale: int) -> DataFrame:
    """Rows (id, label, anchor, v) that take part; v is scaled, not yet rounded."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * scale)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < 1e300))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.floor(np.stack(column.to_numpy()).astype(np.float64))


def _placer(cells: Cells):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                v = _stack(pdf["v"])
                u = v / cells.norm
                cell, dist = cells.nearest(augmented(u))
                # An anchor's further coordinate is 0, so its cell and distance are of another point.
                own, reach = cells.nearest(np.concatenate((u, np.zeros((len(u), 1))), axis=1))
                yield pdf[["id", "label", "anchor"]].assign(cell=cell, dist=dist, own=own, reach=reach, square=(u**2).sum(1), v=[x.tobytes() for x in v])

    return run


def _packer(block_rows: int):
    def pack(rows: pd.DataFrame, block: int) -> dict:
        column = lambda c: rows[c].to_numpy(np.int64).tobytes()
        return {"block": block, "cell": int(rows["cell"].iloc[0]), "lo": float(rows["dist"].min()), "hi": float(rows["dist"].max()), "ids": column("id"), "labels": column("label"), "v": b"".join(rows["v"])}

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, None
        for pdf in frames:
            held = pdf if held is None else pd.concat((held, pdf))
            while len(held):
                size = min(block_rows, int((held["cell"] == held["cell"].iloc[0]).to_numpy().cumprod().sum()))
                if size == len(held) < block_rows:
                    break  # the block may go on in the next frame
                yield pd.DataFrame([pack(held[:size], block)])
                block, held = block + 1, held[size:]
        if held is not None and len(held):
            yield pd.DataFrame([pack(held, block)])

    return run


def _tile(k: int, same: bool, dim: int):
    """Top k scores of each window (tag, lo, hi) of the anchors of a group among the rows of a block."""

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for block in blocks.itertuples(index=False) if len(anchors) else ():
            ids, labels = np.frombuffer(block.ids, np.int64), np.frombuffer(block.labels, np.int64)
            score = products(np.stack([np.frombuffer(v, np.float64) for v in anchors["v"]]), np.frombuffer(block.v, np.float64).reshape(-1, dim))
            for row, s in zip(anchors.itertuples(index=False), score, strict=True):
                fits = (labels == row.label) if same else (labels != row.label)
                at = np.flatnonzero(fits & (ids != row.id) & (s >= min(row.lo)) & (s <= max(row.hi)))
                at = at[np.lexsort((ids[at], -s[at]))]
                down = -s[at]
                for tag, lo, hi in zip(row.tags, row.lo, row.hi, strict=True):
                    first = int(np.searchsorted(down, -hi, "left"))
                    for j in at[first : min(first + k, int(np.searchsorted(down, -lo, "right")))]:
                        out.append((row.id, tag, int(ids[j]), int(s[j])))
        return pd.DataFrame(out, columns=["anchor", "tag", "found", "score"])

    return run


def _targets(cells: Cells, bounds: dict[int, tuple[float, float, float]] | None):
    """The cells whose anchors a block may serve; without bounds, its own."""
    between = cells.between()
    slack = 1e-6  # distances are in units of the largest norm; their error is below 1e-7

    @F.pandas_udf("array<int>")
    def run(cell: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        if bounds is None:
            return pd.Series([[c] for c in cell])
        of = np.array(sorted(bounds), np.int64)
        reach, most, least = (np.array([bounds[i][k] for i in of.tolist()]) for k in range(3))
        out = []
        for c, a, b in zip(cell, lo, hi, strict=True):
            d = between[of, c] if len(of) else np.zeros(0)
            near = np.maximum(0, np.maximum(d - b, a - d) - reach)
            out.append(of[(near <= most + slack) & (d + b + reach >= least - slack) & (of != c)].astype(int).tolist())
        return pd.Series(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _join(anchors: DataFrame, blocks: DataFrame, cells: Cells, k: int, same: bool, dim: int, anchor_rows: int, name: str) -> DataFrame:
    """Rows (anchor, tag, found, score, rank): for each window of each anchor its k best rows.

    anchors: rows (own, reach, square, id, label, v, tags, lo, hi); a window is a tag and the least and largest score.
    """
    counts = {r["own"]: r["n"] for r in anchors.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    chunks = F.array(*[F.lit(max(1, -(-counts.get(i, 0) // anchor_rows))) for i in range(len(cells.pivots))])
    grouped = materialize(anchors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.get(chunks, F.col("own"))).cast("int")), f"{name}-groups")

    def tiles(rows: DataFrame, bounds) -> DataFrame:
        to = _targets(cells, bounds)
        pairs = blocks.select("block", F.explode(to("cell", "lo", "hi")).alias("own")).join(rows.select("own", "chunk").distinct(), "own")
        asked = pairs.join(rows.select("own", "chunk", "id", "label", "v", "tags", "lo", "hi"), ["own", "chunk"])
        served = pairs.join(blocks.select("block", "ids", "labels", "v"), "block").select(F.col("block").alias("b"), F.col("own").alias("o"), F.col("chunk").alias("c"), "ids", "labels", "v")
        return asked.groupBy("block", "own", "chunk").cogroup(served.groupBy("b", "o", "c")).applyInPandas(_tile(k, same, dim), "anchor long, tag long, found long, score long")

    home = materialize(_best(tiles(grouped, None), k), f"{name}-home")
    full = home.groupBy("anchor", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    known = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("tag", "least"))).alias("known"))
    raised = F.zip_with("tags", "lo", lambda t, x: F.greatest(x, F.coalesce(F.try_element_at("known", t), x)))
    now = grouped.join(known, grouped["id"] == known["anchor"], "left").withColumn("lo", raised).drop("known", "anchor")
    now = materialize(now, f"{name}-bounded")
    # |q - x|^2 = |q|^2 + 1 - 2 score / norm^2
    distance = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + 1 - 2 * score / F.lit(cells.norm) / F.lit(cells.norm)))
    low, high = F.array_min("lo"), F.array_max("hi")
    most = F.when(low <= -LIMIT, F.lit(float("inf"))).otherwise(distance(low.cast("double")))
    least = F.when(high >= LIMIT, F.lit(0.0)).otherwise(distance(high.cast("double")))
    per = now.groupBy("own").agg(F.max("reach").alias("reach"), F.max(most).alias("most"), F.min(least).alias("least"))
    bounds = {r["own"]: (r["reach"], r["most"], r["least"]) for r in per.collect()}  # one row a pivot
    away = tiles(now, bounds)
    both = materialize(_best(home.drop("rank").unionByName(away), k), name)
    for done in (grouped, home, now):
        drop_table(done)
    return both


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int | None = None, block_rows: int = 4096, anchor_rows: int = 512
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that is_anchor holds for.

    pivots: number of cells, by default one for 256 anchors, from 8 to 256; any number gives the same rows.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(df, id_col, vector_col, F.col("label") if label is None else label, is_anchor, scale)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    length = F.when(largest == 0, F.lit(0.0)).otherwise(largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))))
    # Rounding down lengthens a vector by less than 1 in each coordinate.
    norm, n_anchors = rows.agg(F.max(length), F.count(F.when(F.col("anchor"), 1))).first()
    norm = (norm + dim) * (1 + 1e-9)
    n_pivots = pivots or min(256, max(8, n_anchors // 256))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(n_pivots).select("v").toPandas()
    cells = Cells.of(_stack(chosen["v"]), norm)
    schema_of = "id long, label long, anchor boolean, cell int, dist double, own int, reach double, square double, v binary"
    placed = materialize(rows.mapInPandas(_placer(cells), schema_of), "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.select("cell", "dist", "id", "label", "v").repartitionByRange(parts, "cell", "dist", "id").sortWithinPartitions("cell", "dist", "id")
    blocks = materialize(sorted_rows.mapInPandas(_packer(block_rows), "block long, cell int, lo double, hi double, ids binary, labels binary, v binary"), "blocks")
    first = F.min(F.struct("label", "v", "own", "reach", "square")).alias("a")
    anchors = placed.where("anchor").groupBy("id").agg(first).select("id", "a.label", "a.v", "a.own", "a.reach", "a.square")
    windows = lambda tags, lo, hi: (tags.alias("tags"), lo.alias("lo"), hi.alias("hi"))
    one = lambda x: F.array(F.lit(x).cast("long"))
    anchors = materialize(anchors, "anchors")
    nearest = _join(anchors.select("*", *windows(one(0), one(-LIMIT), one(LIMIT))), blocks, cells, positives, True, dim, anchor_rows, "positives")
    # Percentages of a score, rounded inwards, without leaving 64 bits.
    down = lambda p: F.expr(f"(score div 100) * {p} + (score % 100) * {p} div 100")
    up = lambda p: F.expr(f"(score div 100) * {p} + ((score % 100) * {p} + 99) div 100")
    asked = nearest.where("score >= 0").select(F.col("anchor").alias("id"), F.col("rank").cast("long").alias("tag"), up(low).alias("lo"), down(high).alias("hi")).where("lo <= hi")
    lists = asked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tag", "lo", "hi"))).alias("w"))
    wanted = anchors.join(lists, "id").select(*anchors.columns, *windows(F.col("w.tag"), F.col("w.lo"), F.col("w.hi")))
    found = _join(wanted, blocks, cells, negatives, False, dim, anchor_rows, "negatives")
    of = nearest.select(F.col("anchor"), F.col("rank").cast("long").alias("tag"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.select("anchor", "tag", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "tag"])
    return named.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
