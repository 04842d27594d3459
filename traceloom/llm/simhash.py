"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: texts lower-cased in A-Z, cut at ASCII white space, word shingles joined by a space, each hashed with
XXH64 (seed 42); a bit is 1 if it is set in over half of the shingles' hashes. Shorter texts are one shingle, texts
without words have fingerprint zero.

Linking within `radius` 2: every distinct fingerprint emits the 65 values within radius 1 of it and the variants are
shuffled, each with the number of the bit that was flipped, which gives the fingerprint back. Two fingerprints share a
variant exactly if they differ in at most 2 bits, so a bucket is a clique of at most 65 distinct fingerprints however many
copies a text has; a bucket therefore emits links to its smallest member only (verified by the bits that differ), not all
pairs. Components come from distributed min-label rounds (large star, small star) over the links, each round written to
the shared folder, with nodes and roots of very many links matched where they are; no links or fingerprints reach the driver.

Defined results: a null text counts as empty; rows with a null id get a fingerprint and the component of their
fingerprint, null if no id belongs to it; rows that repeat an id with another text are fingerprints of their own; repeated
rows share a component; an empty table gives no rows; other columns are not read, and keep_representatives returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, matched, materialize

_BLOCK = 1 << 16  # shingles hashed at a time, which bounds memory for very long texts


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = np.concatenate(([0], ends[:-1]))[:n], (ends - 1)[-n:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), stops[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint(width: int):
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in texts], np.uint64).view(np.int64), pa.int64())

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""
    return df.select(F.col(f"`{id_col}`").alias("id"), _fingerprint(width)(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("fp"))


_FLIPS = [0] + [1 << k if k < 63 else -(1 << 63) for k in range(64)]  # nothing, or one bit


def within_one(fp: Column) -> Column:
    """The 65 values that differ from a fingerprint in at most one bit, in the order of _FLIPS."""
    return F.transform(F.array(*map(F.lit, _FLIPS)), lambda m: fp.bitwiseXOR(m))


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints (fp) that differ in at most 2 bits."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(parts, "fp").select(F.posexplode(within_one(F.col("fp"))).alias("flip", "variant"))
    dealt = spread.select("variant", F.col("flip").cast("byte").alias("flip")).repartition("variant")
    buckets = dealt.groupBy("variant").agg(F.collect_list("flip").alias("flips")).where(F.size("flips") > 1)
    masks = F.array(*map(F.lit, _FLIPS))
    members = F.transform("flips", lambda k: F.col("variant").bitwiseXOR(F.element_at(masks, k.cast("int") + 1)))
    found = buckets.select(members.alias("m")).select(F.array_min("m").alias("b"), F.explode("m").alias("a"))
    return found.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """Rows (fp, component_id, n) of every distinct fingerprint of rows (id, fp): its component's smallest id, its rows."""
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    roots = components(ball_links(reps.select("fp")))
    # A component's root is in no row of its own, so it is named here.
    placed = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    least = materialize(placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size")), "least")
    return matched(placed, least, ["root"], "size").select("fp", "component_id", "n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot_share: int = 1000) -> DataFrame:
    """Rows (id, fingerprint, component_id) of every row of df.

    Fingerprints with more than one of `hot_share` of all rows are fewer than hot_share: their components are broadcast,
    so the copies of one text are not one task's; the others are joined.
    """
    fps = materialize(fingerprints(df, id_col, text_col, width), "fingerprints")
    labels, least = materialize(fingerprint_components(fps), "labels"), fps.count() / hot_share
    hot = F.broadcast(labels.where(F.col("n") > least).select("fp", "component_id"))
    cold = fps.join(hot.select("fp"), "fp", "left_anti").join(labels.where(F.col("n") <= least).select("fp", "component_id").hint("merge"), "fp")
    both = fps.join(hot, "fp").select("id", "fp", "component_id").unionByName(cold.select("id", "fp", "component_id"))
    return both.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of df, with all their columns, that name their component: one document of each group.

    That is the row with the smallest id (null ids last), and of such rows the one with the smallest fingerprint; of rows
    that repeat both, the first by their JSON text. Rows are written once with their fingerprints.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = materialize(df.select(row, F.col(f"`{id_col}`").alias("id"), _fingerprint(width)(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("fp")), "fingerprinted")
    per = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = components(ball_links(per.select("fp")))
    groups = per.join(roots, per["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("k"))
    named = groups.select(F.col("k.rep").alias("rep"), F.col("k.fp").alias("fp"))
    counts = rows.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n"))
    # Merge joins at every size: the list of kept rows grows with the input. A null id is a value of its own here.
    kept = materialize(counts.join(named, (counts["fp"] == named["fp"]) & counts["id"].eqNullSafe(named["rep"])).select(counts["fp"], counts["id"], "n"), "kept")
    same = lambda k: (rows["fp"] == k["fp"]) & rows["id"].eqNullSafe(k["id"])
    once, more = kept.where("n = 1"), kept.where("n > 1")
    out = rows.join(once.hint("merge"), same(once), "left_semi").select("row")
    if not more.isEmpty():
        repeated = rows.join(more.hint("merge"), same(more), "left_semi")
        out = out.unionByName(repeated.groupBy("fp", "id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")
