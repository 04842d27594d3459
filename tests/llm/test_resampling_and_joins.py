"""Importance resampling, the Jaccard join and the Voronoi join against brute force in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceloom.llm import common, importance, jaccard, voronoi
from traceloom.llm.common import table

from ..conftest import DATA

DOCS = "doc_id long, text string, key string, n int, score string, found string, cell string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (4, LONG), (4, LONG), (5, "é ß\t x  y"), (-6, "A B C d e"), (7, "one"), (8, "one ")]
    return spark.createDataFrame([(*r, "k", 9, "s", "f", "c") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents")


# Importance resampling.


def features_of(text):
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute_resample(rows, target, percent):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(features_of(text)[1])
    for text in target:
        t.update(features_of(text)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for name, text in rows:
        words, found = features_of(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        rank[tuple(r)].append(k)
    return [(*r[:4], rank[tuple(r)].pop() if rank.get(tuple(r)) else None) for r in out]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_by_brute_force(spark, odd, docs, percent):
    target = table(spark, DATA, "benchmark")
    want_target = [r["text"] for r in target.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for df in (odd, docs):
        got = importance.resample(df, target, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_resample(rows, want_target, percent), key=key)


def test_resampling_of_empty_tables(spark, odd):
    items = table(spark, DATA, "benchmark")
    assert importance.resample(odd.limit(0), items).count() == 0
    got = importance.resample(odd, items.limit(0), percent=50)
    assert got.count() == odd.count() and got.where("rank IS NOT NULL").count() == 1


def test_blocks_do_not_change_the_buckets():
    texts = [b"a b c", b"", b"c d", LONG.encode(), b"b c d e f"]
    whole = importance.buckets_of(texts)
    apart = [importance.buckets_of([t])[0] for t in texts]
    assert [(n, sorted(f)) for n, f in whole] == [(n, sorted(f)) for n, f in apart]
    assert [(len(features_of(t.decode())[0]), sorted(features_of(t.decode())[1])) for t in texts] == [(n, sorted(f.tolist())) for n, f in whole]


# Jaccard join.


def shingles_of(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_copies(rows, percent=90):
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[find(k)] = min(name, least.get(find(k), name))
    return collections.Counter((name, len(s), least.get(find(k)) if s else name) for k, ((name, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.integers(len(words))
        if rng.random() < 0.5:
            words[at] = f"e{rng.integers(1000)}"
        elif rng.random() < 0.5 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{rng.integers(1000)}")
    return " ".join(words)


@pytest.fixture(scope="module")
def families(spark):
    """Sets of 1 to 90 shingles and copies with edits at their ends and inside; a passage that half of them share."""
    rng, rows = np.random.default_rng(3), []
    for size in [*range(1, 48), 60, 75, 92]:
        base = [f"b{size}x{k}" for k in range(size + 2)]
        rows += [" ".join(base), *(" ".join(base[a : len(base) - b]) for a, b in ((1, 0), (0, 1), (1, 1), (0, 2))), *(edited(rng, base, k) for k in (1, 1, 2))]
    passage = [f"p{k}" for k in range(40)]
    rows += [" ".join(passage + [f"q{i}x{k}" for k in range(i % 7)]) for i in range(60)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize(("most_light", "posting_cost"), [(48, 4), (0, 4), (30, 10**9)])
def test_jaccard_join_by_brute_force(spark, odd, docs, families, most_light, posting_cost):
    both = odd.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True)
    for df in (families, both) if posting_cost == 4 and most_light else (families,):
        got = jaccard.near_copies(df, most_light=most_light, posting_cost=posting_cost, table=1 << 10)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert collections.Counter(map(tuple, got.collect())) == brute_copies(rows)


def test_jaccard_join_at_other_thresholds(spark, families):
    rows = [(r["doc_id"], r["text"]) for r in families.collect()]
    assert collections.Counter(map(tuple, jaccard.near_copies(families, percent=80, most_light=12).collect())) == brute_copies(rows, 80)
    assert jaccard.near_copies(families.limit(0)).count() == 0


@pytest.mark.parametrize("size", [160])
def test_copies_just_outside_the_threshold_are_not_paired_with_each_other(spark, monkeypatch, size):
    """Copies of one text with few to many edits: most differ from each other by more than a link allows, none is lost."""
    rng, base = np.random.default_rng(5), [f"b{k}" for k in range(size)]
    rows = [(0, " ".join(base)), *((k, " ".join(edited(rng, base, int(rng.integers(size // 75, size // 20 + 1))))) for k in range(1, 160))]
    seen, write = [], jaccard.materialize

    def counted(df, name):
        out = write(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = collections.Counter(map(tuple, jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_copies(rows)
    assert len({c for _, _, c in got}) > 10  # not one component
    assert sum(n for name, n in seen if name == "candidates") < 6 * len(rows)  # 805 as measured


def test_bounds_of_sizes():
    for percent in (70, 80, 90, 95, 100):
        for n in range(1, 60):
            assert list(jaccard.partners(n, percent)) == [m for m in range(1, 200) if 100 * min(n, m) >= percent * max(n, m)]
            for m in jaccard.partners(n, percent):
                c = jaccard.overlap(n, m, percent)
                assert 100 * c >= percent * (n + m - c) and 100 * (c - 1) < percent * (n + m - c + 1)
                assert n - c < jaccard.prefix(n, percent)


def test_components_with_hot_nodes(spark):
    rng = np.random.default_rng(5)
    star = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(60)] + [(9000, k) for k in range(9001, 9100)] + [(9050, 8000)]
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.permutation(star)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(pairs).collect()}
    want = {k: 0 for k in range(3000)} | {k: 5000 for k in range(5000, 5061)} | {k: 8000 for k in [8000, *range(9000, 9100)]}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}


# Voronoi join.


def brute_mine(rows, positives=5, negatives=10):
    fine = [(i, lab, [math.floor(256.0 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) and abs(256.0 * x) < 1e300 for x in v)]
    limit, out = (1 << 63) - 1, []
    anchors = {}
    for i, lab, v in fine:
        if i % 10 == 0 and (i not in anchors or (lab, np.array(v, float).tobytes()) < anchors[i][2]):
            anchors[i] = (lab, v, (lab, np.array(v, float).tobytes()))
    for a, (lab, v, _) in anchors.items():
        scored = sorted((-max(-limit, min(limit, sum(x * y for x, y in zip(v, w, strict=True)))), i, other) for i, other, w in fine if i != a)
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            close = [(t, j) for t, j, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(close[:negatives], 1)]
    return collections.Counter(out)


def vectors(kind):
    rng = np.random.default_rng(11)
    if kind == "clusters":
        centers = rng.normal(size=(6, 8)) * 3
        v = centers[rng.integers(6, size=700)] + rng.normal(size=(700, 8)) * 0.2
    else:
        v = rng.normal(size=(700, 8))
    rows = [(k, x.tolist(), int(rng.integers(4)), "x", 1.0) for k, x in enumerate(v)]
    if kind == "odd":
        rows += [(5, rows[40][1], 1, "x", 1.0), (10, rows[41][1], 0, "x", 1.0), (10, rows[42][1], 0, "x", 1.0), (43, rows[43][1], rows[43][2], "x", 1.0), (720, [0.0] * 8, 2, "x", 1.0), (730, rows[50][1], None, "x", 1.0), (740, None, 1, "x", 1.0)]
        rows += [(750, [math.nan] + [1.0] * 7, 1, "x", 1.0), (760, [None] + [1.0] * 7, 1, "x", 1.0), (770, [1.0] * 7, 1, "x", 1.0), (780, [], 1, "x", 1.0), (None, [1.0] * 8, 1, "x", 1.0), (790, [math.inf] * 8, 1, "x", 1.0)]
    if kind == "extreme":
        rows += [(800, [1e200] + [0.0] * 7, 1, "x", 1.0), (801, [1e200] * 8, 1, "x", 1.0), (802, [1e-200] * 8, 1, "x", 1.0), (803, [1e9, -1e9] * 4, 2, "x", 1.0), (810, [1e9, -1e9] * 4, 2, "x", 1.0), (820, [1e307] * 8, 2, "x", 1.0)]
    return rows


@pytest.mark.parametrize("kind", ["clusters", "odd", "extreme"])
def test_hard_negatives_by_brute_force(spark, kind):
    df = spark.createDataFrame(vectors(kind), "vec_id long, embedding array<double>, label int, block string, score double").repartition(5)
    got = voronoi.mine(df, F.col("vec_id") % 10 == 0, pivots=7, block_rows=60, anchor_rows=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(map(tuple, got.collect())) == brute_mine(vectors(kind))


def test_hard_negatives_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert voronoi.mine(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert voronoi.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema), F.lit(False)).count() == 0
    zero = spark.createDataFrame([(k, [0.0, 0.0], k % 2) for k in range(6)], schema)
    got = sorted(map(tuple, voronoi.mine(zero, F.col("vec_id") == 0).collect()))
    assert got == [(0, p, r, n, 0, 0) for p in (2, 4) for r, n in enumerate((1, 3, 5), 1)]


def test_blocks_are_chosen_by_bounds():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(50, 4)) * 0.01 + c for c in np.eye(4)])
    cells = voronoi.Cells.of(points[::50] / 2, 1.0)
    cell, dist = cells.nearest(voronoi.augmented(points / 2))
    assert sorted(set(cell.tolist())) == [0, 1, 2, 3] and (dist < 0.1).all()
    run = voronoi._targets(cells, {0: (0.05, 0.05, 0.0), 1: (0.05, math.inf, 0.0)}).func

    got = run(pd.Series([2, 0]), pd.Series([0.0, 0.0]), pd.Series([0.05, 0.05]))
    assert got.tolist() == [[1], [1]]  # cell 0 is too far from cell 2 for its bound
