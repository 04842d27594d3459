"""N-gram Jaccard self-join: size-aware, with subsets for light sets and inverted lists for heavy ones.

Sets: texts lower-cased in A-Z, cut at ASCII white space, distinct word shingles of `width` words; fewer words are one
shingle. A shingle is a 64-bit hash (of its words' XXH64), so counts and overlaps are exact but for collisions within one
pair of sets, about n^2 / 2^64. Equal sets are one class. Two classes link when 100 * intersection >= `percent` * union,
which for sizes n and m is an overlap of at least c(n, m) = ceil(percent (n + m) / (100 + percent)).

Light sets (size up to the boundary): for each pair of sizes (n, m) that can link, every subset of size c(n, m) is
emitted as the sum of its elements' mixed hashes. All sets that share one are linked with the smallest set of the smaller
size, so a bucket gives a star, not all pairs.
Heavy sets (and the light ones large enough to link with them): postings of the n - c + 1 rarest shingles; two linked sets
share one of them. Rarity is by a table of `table` counts of hashed shingles over all documents, of fixed size; any order
gives right results, it only decides how long lists get.
The boundary is the one with the least cost in the histogram of small sizes: rows of subsets against rows of postings,
each of which counts `posting_cost` times.

Lists are scanned in two rounds, so the near copies of one text are not paired with each other. First every member is
compared with its list's pivot only (the member that has the list's shingle earliest: fewest shingles of its own), and
components of the links found so far are made; two sets that are connected already cannot change a component. Members and
pivots that are alike, linked or not, make families; a family's center is the pivot that most members are like. In the
second round
- two members of one family are compared by what sets them apart from the center: sets x and y differ in as many elements as
  their differences from any third set do. A set that differs from the center in no more than a link allows is linked with
  it (near). Any other set (far) can only link with a set of the family that shares at least one, mostly half, of that set's differences,
  so inverted lists of the first differences find all such pairs (`_differences`), shingles of a family's own text and
  the many pairs of its copies that are just not within the threshold never meet;
- members of one list, of other families and of other components, are compared, those of the list's most usual family only with the others.
Candidates pass the bounds of size and of position in the list and a
parity bitmap of 256 bits (bits that differ are at most the symmetric difference), then, where they are pairs, one with
two bits for every element; what is left is verified by the whole sets. No candidate is dropped without such a bound, so no link between different components is lost.

Joins whose sides grow with the input are merge joins at every size. Hot keys: lists, pivots and classes that hold more than one of 1,000 of all rows are fewer than 1,000; their side is
broadcast and the rows stay where they are (`matched`).

Defined results: null texts and texts without words are empty sets, linked with nothing, whose component is their own id;
rows with a null id have the component of their set, null if no id belongs to it; rows that repeat an id with other texts
are sets of their own; repeated rows share a component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_counts, components, drop_table, matched, materialize, sliced_counts

WORDS = 4  # 64-bit words of a parity bitmap
LIGHT, HEAVY = 0, 1  # kinds of lists
ALIKE = 88  # bits that differ of a parity bitmap of 256 in sets that are alike; 128 with a deviation of 8 in any two
MARKS = 1 << 20  # hashes of texts asked for, as broadcast, whatever the input


def overlap(n: int, m: int, percent: int) -> int:
    """Least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes of sets that can link with one of size n."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: int, percent: int) -> int:
    """Of so many elements, first in any order, a set of size n shares one with each linked set."""
    return n - overlap(n, partners(n, percent)[0], percent) + 1


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A mixing of 64-bit numbers (the published finaliser of SplitMix64)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> its hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes, width: int, hashes: dict) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, in increasing order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total += _mixed(each[k : k + len(total)], k + 1)
    return np.unique(_mixed(total))


def _set_keys(found: list[np.ndarray], salt: int) -> np.ndarray:
    """The sum of each set's mixed hashes."""
    ends = np.cumsum([0, *map(len, found)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(np.concatenate([*found, np.zeros(0, np.uint64)]), salt), dtype=np.uint64)])[ends]
    return (total[1:] - total[:-1]).view(np.int64)


def _parity(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bit k of so many 64-bit words (a power of two): whether an odd number of elements is k modulo their bits."""
    odd = (np.bincount((found & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _long_words(n: int) -> int:
    return max(WORDS, 1 << max(0, (n - 1) // 32).bit_length())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text"))


def _sets(rows: DataFrame, width: int, salt: int, table: int) -> DataFrame:
    """Rows (id, hash, n, key, check, bits, long_bits) from rows (id, hash, text), and each task's counts as rows (slice, level, counts)."""
    names = ["id", "hash", "n", "key", "check", "bits", "long_bits", "slice", "level", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, kind = _Hashes(), np.zeros(table, np.int64), None
        for batch in _small(batches):
            kind = batch.column("id").type
            found = [shingles(t, width, hashes) for t in _texts(batch)]
            total += np.bincount((np.concatenate([*found, np.zeros(0, np.uint64)]) % np.uint64(table)).astype(np.int64), minlength=table)
            keys = [pa.array(_set_keys(found, salt + k)) for k in (0, 1)]
            bits = [_lists([_parity(f, size(len(f))) for f in found]) for size in (lambda n: WORDS, _long_words)]
            own = [batch.column("id"), batch.column("hash"), pa.array(map(len, found), pa.int32()), *keys, *bits]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(found), t) for t in (pa.int32(), pa.int64(), pa.binary()))], names)
        if kind is not None:
            counts = sliced_counts(total)
            none = (kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(counts[0]), t) for t in none), *counts], names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash long, n int, key long, check long, bits array<long>, long_bits array<long>, slice int, level long, counts binary")


def _rarity(counts: np.ndarray) -> np.ndarray:
    """The place of each cell of the table of counts, the rarest first."""
    place = np.empty(len(counts), np.uint64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return place


def _signatures(n: int, boundary: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(smaller size, larger size, subset size, side) of the subsets that a light set of size n emits."""
    out = [(n, m, overlap(n, m, percent), 0) for m in partners(n, percent) if n <= m <= boundary]
    return out + [(m, n, overlap(n, m, percent), 1) for m in partners(n, percent) if 0 < m < n]


def boundary_of(sizes: dict[int, int], heavy_rows: int, percent: int, most: int, posting_cost: int) -> int:
    """The boundary with the least cost. sizes: number of sets of each size up to `most`; heavy_rows: postings of larger ones."""

    def cost(x: int) -> int:
        light = sum(k * sum(math.comb(n, c) for _, _, c, _ in _signatures(n, x, percent)) for n, k in sizes.items() if n <= x)
        return light + posting_cost * (heavy_rows + sum(k * prefix(n, percent) for n, k in sizes.items() if partners(n, percent)[-1] > x))

    return min(range(most + 1), key=cost)


def _subset_sums(mixed: np.ndarray, size: int) -> np.ndarray:
    """Sums of all subsets of a size, by the elements left out."""
    total, left = mixed.sum(dtype=np.uint64), len(mixed) - size
    if not left:
        return np.array([total])
    out = np.array(list(itertools.combinations(range(len(mixed)), left)))
    return total - mixed[out].sum(1, dtype=np.uint64)


def _postings(rows: DataFrame, width: int, salt: int, place: np.ndarray, boundary: int, percent: int) -> DataFrame:
    """Rows (kind, token, key, n, pos, side): subsets of light sets, prefixes of heavy ones; copies in a task give one."""
    table = np.uint64(len(place))
    signatures = {n: _signatures(n, boundary, percent) for n in range(1, boundary + 1)}

    def of(found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        n = len(found)
        if n <= boundary:
            mixed = _mixed(found, salt + 2)
            for small, large, size, side in signatures[n]:
                yield LIGHT, _mixed(_subset_sums(mixed, size), small * 1000 + large), np.zeros(0), side
        if partners(n, percent)[-1] > boundary:
            # By place, then by the hash: one number, whose ties keep the order of the hashes.
            rank, size = place[(found % table).astype(np.int64)] << np.uint64(32) | found >> np.uint64(32), prefix(n, percent)
            near = np.flatnonzero(rank <= np.partition(rank, size - 1)[size - 1])
            order = near[np.argsort(rank[near], kind="stable")][:size]
            yield HEAVY, found[order], np.arange(len(order)), 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in _small(batches):
            rows = []
            sets = [shingles(text, width, hashes) for text in _texts(batch)]
            for found, key in zip(sets, _set_keys(sets, salt).tolist(), strict=True):
                if not len(found) or key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                rows += [(kind, tokens, key, len(found), pos, side) for kind, tokens, pos, side in of(found)]
            counts = [len(r[1]) for r in rows]
            spread = lambda k, t: pa.array(np.repeat(np.array([r[k] for r in rows], t), counts))
            tokens = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            pos = np.concatenate([r[4] if len(r[4]) else np.zeros(len(r[1])) for r in rows] or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([spread(0, np.int8), pa.array(tokens), spread(2, np.int64), spread(3, np.int32), pa.array(pos), spread(5, np.int8)], ["kind", "token", "key", "n", "pos", "side"])

    return rows.select("text").mapInArrow(run, "kind byte, token long, key long, n int, pos int, side byte")


def _need(n: str, m: str, percent: int) -> str:
    return f"CAST(floor(({percent} * ({n} + {m}) + {99 + percent}) / {100 + percent}) AS INT)"


_DIFFER = "(" + " + ".join(f"bit_count(p.bits[{k}] ^ q.bits[{k}])" for k in range(WORDS)) + ")"


def _may_link(percent: int, boundary: int) -> str:
    """Bounds on a pair of members p and q of one list: one heavy, sizes, positions (of the first shingle that both share), parity bitmaps."""
    c = _need("p.n", "q.n", percent)
    heavy = f"(greatest(p.n, q.n) > {boundary} AND least(p.n - p.pos, q.n - q.pos) >= {c})"
    return f"(p.kind = {LIGHT} OR {heavy}) AND least(p.n, q.n) >= {c} AND {_DIFFER} <= p.n + q.n - 2 * {c}"


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose long parity bitmaps leave room for a link; of two lengths, the longer is folded onto the shorter."""
    out = pairs
    for side in "ab":
        degree = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("degree"))
        of = classes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("long_bits").alias(f"bits_{side}"))
        out = matched(out, materialize(of.join(degree.hint("merge"), side), "bitmaps"), [side], "degree")
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    differ = F.aggregate(F.zip_with(fit(F.col("bits_a"), F.col("bits_b")), fit(F.col("bits_b"), F.col("bits_a")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, x: a + x)
    return out.where(differ <= F.expr(f"n_a + n_b - 2 * {_need('n_a', 'n_b', percent)}")).select("a", "b")


def _texts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, a written table with columns (hash, of), with the column text of the rows (id, hash, text); most other rows stay where they are."""
    marks = asked.select(F.pmod("hash", F.lit(MARKS)).alias("mark")).distinct()
    some = rows.withColumn("mark", F.pmod("hash", F.lit(MARKS))).join(F.broadcast(marks), "mark", "left_semi").drop("mark").withColumnRenamed("hash", "text_hash")
    return some.join(asked.hint("merge"), (F.col("text_hash") == F.col("hash")) & F.col("id").eqNullSafe(F.col("of"))).drop("id", "text_hash")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, table: str) -> DataFrame:
    """Links (a, b) of the candidate pairs (a, b), by the intersection of the whole sets of their two texts."""

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        hashes, out = _Hashes(), []
        for x, y in zip(left, right, strict=True):
            a, b = (shingles(t.as_buffer().to_pybytes(), width, hashes) for t in (x, y))
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    pairs = materialize(_screened(pairs, classes, percent), "screened")
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    degrees = materialize(sides.groupBy("key").agg(F.count(F.lit(1)).alias("degree")).join(classes.select("key", "handle").hint("merge"), "key"), "degrees")
    asked = materialize(matched(sides, degrees, ["key"], "degree").select(F.col("handle.id").alias("of"), F.col("handle.hash").alias("hash"), "key", "a", "b"), "sides")
    texts = _texts_of(rows, asked).select("a", "b", "key", "text")
    both = texts.groupBy("a", "b").agg(*[F.max(F.when(F.col("key") == F.col(c), F.col("text"))).alias(f"text_{c}") for c in "ab"])
    return materialize(both.where(linked("text_a", "text_b")).select("a", "b"), table)


def _families(alike: DataFrame) -> DataFrame:
    """Rows (key, center) of the sets in pairs (a, b) of a member and a pivot that are alike: the pivot of its family that most members are like."""
    roots = components(alike)
    votes = alike.groupBy("b").agg(F.count(F.lit(1)).alias("votes"))
    placed = votes.join(roots.hint("merge"), votes["b"] == roots["node"], "left").select(F.coalesce("root", "b").alias("family"), F.struct("votes", "b").alias("vote"))
    centers = placed.groupBy("family").agg(F.max("vote")["b"].alias("center"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    per = materialize(sizes.join(centers.hint("merge"), sizes["root"] == centers["family"]).select("family", "center", "size"), "families")
    members = roots.select(F.col("node").alias("key"), F.col("root").alias("family")).unionByName(per.select(F.col("family").alias("key"), "family"))
    return materialize(matched(members, per, ["family"], "size").select("key", "center"), "centers")


def _differences(members: DataFrame, centers: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (center, token, p, far, short) of the differences of each member from its center that a linked pair may share first.

    members: (key, n, bits, handle, center, root, size), centers: (center, handle, size), written tables. p: (key, n, pos, d, root,
    bits), d the number of differences. token is null for a member that is near, with key and center as a link.
    A pair with a far set of d > d0 differences, d0 the most that it may have from the center, and another of e, whose sizes
    differ by k from the center's, shares at least (d + e - (what the pair may differ in)) / 2 >= (e + 1 - k) / 2 differences,
    as what a pair may differ in grows by k at most. Those of a set that come first, as many as leave fewer than that, are
    short; a far set asks with all that leave fewer than it must share with any set. Of two far sets both meet by short ones.
    """
    key = lambda df: df.select(F.col("handle.id").alias("of"), F.col("handle.hash").alias("hash"), *(c for c in df.columns if c != "handle"))
    own = _texts_of(rows, materialize(key(members), "asked")).drop("hash", "of")
    shared = materialize(_texts_of(rows, materialize(key(centers), "asked")).select("center", F.col("text").alias("shared"), "size").dropDuplicates(["center"]), "center-texts")
    both = matched(own.drop("size"), shared, ["center"], "size", most=64).select("key", "n", "center", "root", "bits", "text", "shared")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, base = _Hashes(), None, np.zeros(0, np.uint64)
        for batch in _small(batches, 200):
            tokens, counts, out = [], [], []
            for k, (text, shared, center) in enumerate(zip(batch.column("text"), batch.column("shared"), batch.column("center").to_pylist(), strict=True)):
                if center != last:
                    last, base = center, shingles(shared.as_buffer().to_pybytes(), width, hashes)
                found = shingles(text.as_buffer().to_pybytes(), width, hashes)
                # First those that the center has not, which few of a family share.
                apart = np.concatenate([np.setdiff1d(found, base, assume_unique=True), np.setdiff1d(base, found, assume_unique=True)])
                n, m, d = len(found), len(base), len(apart)
                may = lambda x: n + x - 2 * overlap(n, x, percent)  # noqa: B023, E731  what may differ
                most = max(map(may, partners(n, percent)))
                far = d > may(m)
                full = d + 1 - max(1, -(-(d + max(1, d - most) - most) // 2))
                short = min(full, d + 1 - max(1, -(-(d + 1 - abs(n - m)) // 2)))
                upto = full if far else short
                tokens += [apart[:upto], np.zeros(0 if far else 1, np.uint64)]
                counts += [upto, 0 if far else 1]
                out += [(k, d, far, short)] * 2
            of = np.repeat(np.arange(len(counts)), counts)
            row, d, far, short = (np.array([o[c] for o in out], np.int64)[of] for c in range(4))
            pos = np.arange(len(of)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts) if counts else of
            link = of % 2 == 1
            token = pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64), mask=link)
            at = pa.array(row)
            columns = [batch.column(c).take(at) for c in ("center", "key", "n", "root", "bits")]
            yield pa.RecordBatch.from_arrays([*columns, token, pa.array(pos.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(far.astype(bool)), pa.array(pos < short)], ["center", "key", "n", "root", "bits", "token", "pos", "d", "far", "short"])

    found = both.mapInArrow(run, "center long, key long, n int, root long, bits array<long>, token long, pos int, d int, far boolean, short boolean")
    return materialize(found.select("center", "token", F.struct("key", "n", "pos", "d", "root", "bits").alias("p"), "far", "short"), "differences")


def _within(families: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links with centers, candidate pairs) of the sets of families (key, center, root) that are in several components."""
    several = families.groupBy("center").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("center", "size")
    several = materialize(several, "several")
    members = matched(families, several.withColumn("times", F.col("size")), ["center"], "times").join(classes.select("key", "n", "bits", "handle").hint("merge"), "key")
    centers = several.join(classes.select(F.col("key").alias("center"), "handle").hint("merge"), "center")
    found = _differences(materialize(members, "family-members"), materialize(centers, "family-centers"), rows, width, percent)
    links = found.where("token IS NULL").select(F.col("p.key").alias("a"), F.col("center").alias("b")).where("a <> b")
    lists = found.where("token IS NOT NULL")
    asking = lists.where("far").select("center", "token", "p", F.col("short").alias("both"))
    # A pair is found by the first of the differences that it shares.
    answers = lists.where("short").select("center", "token", F.col("p").alias("q"), F.col("far").alias("q_far"))
    share = f"floor((p.d + q.d - (p.n + q.n - 2 * {_need('p.n', 'q.n', percent)}) + 1) / 2)"
    differ = f"p.n + q.n - 2 * {_need('p.n', 'q.n', percent)}"
    fit = f"p.root <> q.root AND (NOT q_far OR (both AND p.key < q.key)) AND least(p.n, q.n) >= {_need('p.n', 'q.n', percent)} AND least(p.d - p.pos, q.d - q.pos) >= {share} AND {_DIFFER} <= {differ}"
    pairs = asking.join(answers.hint("merge"), ["center", "token"]).where(fit)
    return links, pairs.select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b"))


def linked_sets(rows: DataFrame, classes: DataFrame, place: np.ndarray, width: int, salt: int, percent: int, most_light: int, posting_cost: int) -> DataFrame:
    """Rows (node, root): components of the classes that have a link; rows (id, hash, text), classes (key, n, handle, bits)."""
    small = {r["n"]: r["k"] for r in classes.where(F.col("n") <= most_light).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most most_light rows
    least_partner = F.ceil(F.col("n") * percent / 100)
    heavy_rows = classes.where(F.col("n") > most_light).agg(F.sum(F.col("n") + 1 - F.ceil((F.col("n") + least_partner) * percent / (100 + percent)))).first()[0] or 0
    boundary = boundary_of(small, int(heavy_rows), percent, most_light, posting_cost)
    postings = materialize(_postings(rows, width, salt, place, boundary, percent), "postings")
    # A light list without a set of the smaller size is no list of links.
    pivot = F.min_by("key", F.when(F.col("side") == 0, F.col("pos")))
    lists = postings.groupBy("kind", "token").agg(pivot.alias("pivot"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("size"))
    lists = materialize(lists.where("lo < hi AND pivot IS NOT NULL").select("kind", "token", "pivot", "size"), "lists")
    distinct = matched(postings, lists, ["kind", "token"], "size").dropDuplicates(["kind", "token", "key"])
    members = distinct.select("kind", "token", "key", "pos", "pivot").join(classes.select("key", "n", "bits").hint("merge"), "key")
    members = materialize(members, "members")
    drop_table(postings)
    bounds = _may_link(percent, boundary)
    sizes = members.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("size")).hint("merge")
    heads = materialize(members.where("key = pivot").join(sizes, ["kind", "token"]).select("kind", "token", F.struct("key", "n", "pos", "bits", "kind").alias("p"), "size"), "heads")
    member = F.struct("key", "n", "pos", "bits", "kind").alias("q")
    ordered = lambda df: df.select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b"))
    with_head = matched(members.where("key <> pivot").select("kind", "token", member), heads, ["kind", "token"], "size")
    with_head = with_head.select(F.col("q.key").alias("a"), F.col("p.key").alias("b"), F.col("q.n").alias("n"), F.expr(bounds).alias("may"), F.expr(f"p.kind = {HEAVY}").alias("heavy"), F.expr(f"{_DIFFER} <= {ALIKE}").alias("near")).where("may OR (near AND heavy)")
    # Long sets, whose bitmaps are full, are alike if they share an eighth of the shingles that can make a link.
    shared = F.count_if("heavy")
    alike = F.max(F.expr("near AND heavy")) | ((shared >= 4) & (shared * 8 * (100 + percent) >= F.max("n") * (100 - percent) * 2))
    compared = materialize(with_head.groupBy("a", "b").agg(F.max("may").alias("may"), alike.alias("alike")), "compared")
    pairs = compared.where("may").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "candidates")
    links = _verified(pairs, rows, classes, width, percent, "verified")
    roots = components(links)
    centers = _families(compared.where("alike").select("a", "b"))
    # Second round: families, and lists, in which not all members are in one component.
    families = centers.join(roots.hint("merge"), centers["key"] == roots["node"], "left").select("key", "center", F.coalesce("root", "key").alias("root"))
    families = materialize(families, "rooted")
    near, within = _within(families, classes, rows, width, percent)
    alone = roots.join(centers.hint("merge"), roots["node"] == centers["key"], "left_anti").select(F.col("node").alias("key"), F.col("node").alias("center"), "root")
    places = families.unionByName(alone).withColumnRenamed("key", "place")
    named = members.where(f"kind = {HEAVY}").join(places.hint("merge"), members["key"] == places["place"], "left").select("kind", "token", member, F.coalesce("root", "key").alias("root"), F.coalesce("center", "key").alias("center"))
    named = materialize(named, "named")
    shares = named.groupBy("token", "center").agg(F.count(F.lit(1)).alias("n"))
    usual = shares.groupBy("token").agg(F.max(F.struct("n", "center")).alias("top"), F.count(F.lit(1)).alias("centers"), F.sum("n").alias("size")).where("centers > 1").select("token", F.col("top.center").alias("usual"), "size")
    mixed = materialize(matched(named, materialize(usual, "mixed-lists"), ["token"], "size"), "mixed")
    others = mixed.where("center <> usual").select("token", F.col("q").alias("p"), F.col("root").alias("of"), F.col("center").alias("aside"))
    # Of two members outside the most usual family, the smaller key asks.
    across = mixed.join(others.hint("merge"), "token").where("root <> of AND center <> aside AND (center = usual OR q.key > p.key)").where(bounds)
    left = materialize(ordered(across).unionByName(within).distinct().join(pairs, ["a", "b"], "left_anti"), "candidates")
    more = _verified(left, rows, classes, width, percent, "verified")
    return components(links.unionByName(near).unionByName(more))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, table: int = 1 << 18, most_light: int = 48, posting_cost: int = 4) -> DataFrame:
    """Rows (id, n_shingles, component_id) of every row of df."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    text = F.col(f"`{text_col}`")
    rows, salt = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")), 0
    while True:
        found = materialize(_sets(rows, width, salt, table), "sets")
        sets = found.where("slice IS NULL").select("id", "hash", "n", "key", "check", "bits", "long_bits")
        handle = F.min(F.struct("id", "hash")).alias("handle")
        per = sets.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("id").alias("rep"), handle, F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("long_bits").alias("long_bits"), F.min("check").alias("check"), F.max("check").alias("other"))
        classes = materialize(per, "classes")
        if classes.where("check <> other").isEmpty():
            break
        salt += 3  # two different sets have one key: other keys for all
    place = _rarity(added_counts(found.where("slice IS NOT NULL").select("slice", "level", "counts"), table))
    roots = linked_sets(rows, classes, place, width, salt, percent, most_light, posting_cost)
    placed = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "rep", "copies", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("size"))
    labels = materialize(matched(materialize(placed, "placed"), materialize(least, "least"), ["root"], "size").select("key", "component_id", "copies"), "labels")
    full = matched(sets.where("n > 0").select("id", "n", "key"), labels, ["key"], "copies").select("id", "n", "component_id")
    out = full.unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
