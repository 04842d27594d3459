"""Sorted tables, the full-text index, joins by grams, profile rules, carried values, chains, journals in ranges and streams."""

import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from traceloom.operators import aggregate, annotate, fulltext, grams, ioc, lateral, process, sorted_table, temporal
from traceloom.operators.filters import full_text
from traceloom.sources import journal_source
from traceloom.sources.artifacts import parse_usn

from .conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def index(docs):
    return fulltext.build_index(docs, ["text", "source"], "doc_id", files=12)


@pytest.mark.parametrize("term", ["license", '"apache license"', "lic*", 'license "the apache"', "the a*", "nowhere", "", "...", "apache.license token", '"no such phrase" the', "THE", 'the "the'])
def test_index_finds_what_the_scan_finds(docs, index, term):
    want = sorted(r[0] for r in docs.where(full_text(["text", "source"], term)).select("doc_id").collect())
    assert sorted(r[0] for r in index.search(docs, term, "doc_id").select("doc_id").collect()) == want


def test_phrases_with_repeated_words_and_columns_apart(spark):
    rows = [(1, "a b a b c", "x"), (2, "a b", "a b c"), (3, "b a", "c"), (4, None, ""), (5, "a a b", "a-b.c")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    index = fulltext.build_index(df, ["t", "u"], "id")
    for term in ('"a b a"', '"a b c"', '"a a"', "a.b.c", '"b x"', "c a", "c* x*"):
        want = sorted(r[0] for r in df.where(full_text(["t", "u"], term)).select("id").collect())
        assert sorted(r[0] for r in index.found(term).collect()) == want, term
    with pytest.raises(ValueError, match="63"):
        index.found(" ".join(f"w{k}" for k in range(70)))


def test_a_search_opens_the_files_of_its_words(index):
    files = index.table.bounds().count()
    read = index.table.where_key((F.lit("license"), F.lit("license")))
    assert files >= 8 and len(read.inputFiles()) <= 2
    assert {r[0] for r in read.select("token").distinct().collect()} <= {"license"}


def test_an_index_is_found_again_by_its_path(spark, docs, tmp_path):
    fulltext.build_index(docs.limit(20), ["text"], "doc_id", str(tmp_path / "index"))
    again = fulltext.TextIndex(sorted_table.SortedTable(spark, str(tmp_path / "index"), ("token", "id", "column", "position")), ("text",))
    assert again.found("the").count() == docs.limit(20).where(full_text(["text"], "the")).count()


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_key_are_the_pages_by_offset(spark, descending):
    random.seed(1)
    rows = [(random.choice([None, *range(30)]), k) for k in range(1000)]
    table = sorted_table.write_sorted(spark.createDataFrame(rows, "v int, id int"), ["v", "id"], files=9)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want, last, got = sorted(rows, key=key, reverse=descending), None, []
    for _ in itertools.count():
        page = table.page(last, 170, descending)
        assert len(page.inputFiles()) <= 4
        found = sorted(map(tuple, page.collect()), key=key, reverse=descending)
        if not found:
            break
        got += found
        last = found[-1]
    assert got == want


def test_a_page_larger_than_its_files_and_empty_tables(spark):
    rows = spark.range(500).select(F.col("id").alias("k"))
    table = sorted_table.write_sorted(rows, ["k"], files=100)
    assert sorted(r[0] for r in table.page((99,), 400).collect()) == list(range(100, 500))
    empty = sorted_table.write_sorted(rows.limit(0), ["k"])
    assert empty.page().count() == 0 and empty.page((3,)).count() == 0 and empty.where_key((F.lit(1), F.lit(2))).count() == 0


def test_needles_by_grams(spark):
    random.seed(2)
    word = lambda n: "".join(random.choice("ab.1é") for _ in range(n))
    texts = [(k, word(random.randrange(0, 40))) for k in range(200)] + [(900, "😀 evil.com 😀"), (901, None)]
    needles = sorted({word(random.choice((1, 2, 3, 4, 5, 6, 9))) for _ in range(80)} | {"evil.com", "😀"})
    got = grams.containing(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted((k, n) for k, t in texts if t for n in needles if n in t)
    none = grams.containing(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame([], "n string"), "n")
    assert none.count() == 0 and none.columns == ["id", "t", "n"]


def test_many_indicators_give_what_few_give(spark, docs):
    names = docs.limit(30).select(F.lower(F.substring("text", 20, 9)).alias("ioc")).where("trim(ioc) <> ''").distinct()
    few, many = (sorted(map(tuple, ioc.match(docs, names, ["text"], "doc_id", at_once=k).collect())) for k in (1000, 3))
    assert few == many and few


def test_profile_rules_of_every_kind(spark):
    random.seed(3)
    pick = lambda *v: random.choice(v)
    found = [(k, pick("C:\\x\\A.exe", "b.exe", None), pick("p.exe", ""), pick("h1", "H2", None), pick("u", "v"), pick("run -x one", "RUN -y two", "", None)) for k in range(300)]
    rules = [(pick("a.EXE", "", None), pick("P.exe", None), pick("H1", "", "h2"), pick(None, "U"), pick(None, "c:\\X\\a.exe"), pick(None, "", "-X", "two", "n -")) for _ in range(12)] + [(None, None, None, None, None, "-y t"), ("",) * 6]
    names = ("process", "parent", "host", "user", "image_path", "command_contains")
    low = lambda v: (v or "").lower()

    def matches(f, r):
        own = {"process": low(f[1]).split("\\")[-1], "parent": low(f[2]).split("\\")[-1], "host": low(f[3]), "user": low(f[4]), "image_path": low(f[1])}
        filled = {n: low(v) for n, v in zip(names, r, strict=True) if v}
        return bool(filled) and all(v in low(f[5]) if n == "command_contains" else own[n] == v for n, v in filled.items())

    df = spark.createDataFrame(found, "id int, image string, parent_image string, host string, user string, command string")
    table = spark.createDataFrame(rules, ", ".join(f"{n} string" for n in names))
    for rs in (rules, rules[:3], rules[-1:]):
        got = annotate.profile_flag(df, spark.createDataFrame(rs, table.schema), "known")
        assert got.columns == [*df.columns, "known"]
        assert {r["id"]: r["known"] for r in got.collect()} == {f[0]: any(matches(f, r) for r in rs) for f in found}
    both = annotate.with_profile(df, table, table.limit(0)).withColumn("level", F.lit(2))
    assert both.where("expected").count() == 0 and process.view(both, "raw").count() == 300
    assert process.view(both, "hunt").count() == both.where("NOT suppressed").count()
    assert annotate.merged_rules(table, table.select("process", "host")).columns == list(names)


def test_profiles_of_columns(spark):
    rows = [(k, f"v{k % 3}" if k % 5 else "", float(k) if k % 2 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, kind string, x double").withColumn("at", F.timestamp_seconds(F.col("id") * 60))
    got = {r["column"]: r for r in aggregate.column_profile(df, tracked=64).collect()}
    kinds = [f"v{k % 3}" for k in range(1000) if k % 5]
    assert [(t["item"], t["count"]) for t in got["kind"]["top"]] == sorted(((v, kinds.count(v)) for v in set(kinds)), key=lambda x: (-x[1], x[0]))
    assert got["kind"]["top_exact"] and not got["id"]["top_exact"] and got["kind"]["non_empty"] == 800
    assert got["x"]["numbers"] == 500 and got["x"]["mean_value"] == 500.0 and got["x"]["min_value"] == "1.0" and len(got["id"]["bounds"]) == 9
    assert got["at"]["span_seconds"] == 999 * 60 and got["at"]["mean_value"] is None and abs(got["id"]["bounds"][4] - 499) <= 2
    assert aggregate.column_profile(df.limit(0)).count() == 4


def test_values_carried_over_slots(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), k, random.choice([None, *range(9)]), random.randrange(5)) for k in random.sample(range(40_000), 600)]
    df = spark.createDataFrame(rows, "k string, s long, v int, n int").withColumn("ts", F.when(F.col("s") > 50, F.timestamp_seconds("s")))
    got = temporal.carried(df, ["k"], ["ts", "s"], "ts", {"last_v": F.col("v")}, {"total": F.col("n")}, slot_seconds=900)
    want = []
    for key in ("a", "b", None):
        last, total = None, 0
        for _, s, v, n in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] > 50, r[1])):
            total += n
            want.append((key, s, last, total))
            last = v if v is not None else last
    assert {(r["k"], r["s"]): (r["last_v"], r["total"]) for r in got.collect()} == {(k, s): (v, t) for k, s, v, t in want}


def all_chains(hops):
    """Every simple path that fits in time, with its earliest arrival."""
    best, grown = {}, {(s, t): min(x for a, b, x in hops if (a, b) == (s, t)) for s, t, _ in hops if s != t}
    while grown:
        best |= grown
        further = {}
        for path, at in grown.items():
            for s, t, x in hops:
                if s == path[-1] and t not in path and x >= at:
                    new = (*path, t)
                    further[new] = min(x, further.get(new, x))
        grown = further
    return best


def test_chains_by_labels_in_a_graph_with_cycles(spark):
    random.seed(5)
    hops = [(random.choice("abcdef"), random.choice("abcdef"), random.randrange(12)) for _ in range(22)]
    df = spark.createDataFrame(hops, "source string, target string, ts int")
    want = all_chains(hops)
    got = {tuple(r["path"]): r["arrives"] for r in lateral.chain_labels(df, keep=10_000, salt_rows=3).collect()}
    assert got == want
    few = lateral.chain_labels(df, keep=2)
    assert all(want[tuple(r["path"])] == r["arrives"] for r in few.collect()) and few.groupBy("host", "hops").count().agg(F.max("count")).first()[0] <= 2
    longest = {}
    for path, at in want.items():
        longest[path[-1]] = min(longest.get(path[-1], (0, 0, ())), (1 - len(path), at, path))
    assert {r["host"]: (r["hops"], r["arrives"], r["path"]) for r in lateral.longest_chains(df, keep=10_000).collect()} == {h: (-n, at, ">".join(p)) for h, (n, at, p) in longest.items()}
    assert lateral.longest_chains(df.limit(0)).count() == 0 and lateral.chain_labels(df, max_hops=2).agg(F.max("hops")).first()[0] == 2


def test_a_logoff_that_names_nothing_is_linked_within_a_minute(spark):
    rows = [(4624, 0, "A", "T", "u", None), (4634, 50, "", "T", "u", None), (4624, 1000, "A", "T", "u", "7"), (4634, 2000, "", "T", "u", None), (4624, 3000, "A", "T", "u", "8"), (23, 9000, "", "T", "u", "8")]
    df = spark.createDataFrame(rows, "event_id int, at int, source string, target string, user string, session_id string").withColumn("ts", F.timestamp_seconds("at"))
    got = [(r["n"], r["status"]) for r in lateral.rdp_sessions(df).orderBy("first_ts").collect()]
    assert got == [(2, "ENDED"), (1, "INCOMPLETE"), (1, "ENDED"), (2, "ENDED")]
    grouped = lateral.session_groups(lateral.rdp_sessions(df), many=0).where("source = 'A' AND status = 'ENDED'").first()
    assert grouped["sessions"] == 2 and grouped["events"] == 4 and grouped["many"]


def record(usn, name, version=2):
    raw, head = name.encode("utf-16-le"), 60 if version == 2 else 76
    size = head + len(raw) + (-(head + len(raw)) % 8)
    if version == 2:
        out = struct.pack("<IHHQQQQIIIIHH", size, 2, 0, (1 << 48) | 7, (1 << 48) | 5, usn, 133_498_026_000_000_000, 0x100, 0, 0, 32, len(raw), 60)
    else:
        out = struct.pack("<IHHQQQQQQIIIIHH", size, 3, 0, (1 << 48) | 7, 0, (1 << 48) | 5, 0, usn, 133_498_026_000_000_000, 0x100, 0, 0, 32, len(raw), 76)
    return (out + raw).ljust(size, b"\0")


@pytest.mark.parametrize("split", [8, 64, 1000, 4096, 1 << 20])
def test_journals_in_ranges(spark, tmp_path, split):
    random.seed(6)
    data = b"\0" * 128
    for k in range(150 if split < 100 else 1500):
        data += record(k, "n" * random.randrange(1, 60) + str(k), random.choice((2, 3))) + b"\0" * random.choice((0, 0, 8, 64))
    (tmp_path / "a.usn").write_bytes(data)
    (tmp_path / "empty.usn").write_bytes(b"")
    want = sorted((r[0], r[5], r[9]) for r in parse_usn(data))
    got = journal_source.read_journal(spark, str(tmp_path), split)
    assert sorted((r["name"], r["usn"], r["offset"]) for r in got.collect()) == want and len(want) >= 150
    parts = journal_source.JournalReader({"path": str(tmp_path), "split_bytes": str(split)}).partitions()
    assert len(parts) == -(-len(data) // split)
    with pytest.raises(FileNotFoundError):
        journal_source.JournalReader({"path": str(tmp_path / "none")}).partitions()


def test_late_rows_of_a_stream_are_counted(spark, tmp_path):
    from traceloom.streaming.sessions import stateful_store, stream_rdp_sessions

    stateful_store(spark)
    schema = "event_id int, ts timestamp, source string, target string, user string, session_id string"
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    row = lambda e, s, t="T": spark.range(1).select(F.lit(e).alias("event_id"), at(s).alias("ts"), F.lit("A").alias("source"), F.lit(t).alias("target"), F.lit("u").alias("user"), F.lit("1").alias("session_id"))
    source = str(tmp_path / "in")
    for rows in (row(4624, 0).union(row(23, 10)), row(0, 10**7, "end"), row(4624, 5), row(0, 2 * 10**7, "end")):
        rows.coalesce(1).write.mode("append").parquet(source)
        query = stream_rdp_sessions(spark.readStream.schema(schema).parquet(source)).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        query.awaitTermination()
        if rows.count() == 1 and rows.first()["event_id"] == 4624:
            assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1
    got = spark.read.parquet(str(tmp_path / "out")).where("target = 'T'").collect()
    assert [(r["n"], r["status"]) for r in got] == [(2, "ENDED")]


def test_saved_paths_follow_a_changed_file_table(spark):
    from traceloom.operators import ntfs

    rows = [(k, 100 + k, 1, random.Random(k).choice([5, 900, 901, 902, 903]), 1, f"f{k}", k % 7 == 0) for k in range(200)]
    rows += [(1000 + k, 5000 + k, 1, 100 + 7 * (k % 20), 1, f"g{k}", False) for k in range(60)]
    records = spark.createDataFrame(rows, "usn long, entry long, seq int, parent_entry long, parent_seq int, name string, is_dir boolean")
    table = lambda *rows: spark.createDataFrame(list(rows), "entry long, parent long, name string")
    steps = [None, table((900, 5, "a"), (901, 900, "b")), table((900, 5, "c"), (901, 900, "b"), (902, 5, "d")), table((902, 5, "d"))]
    saved = ntfs.saved_paths(records)
    for before, after in itertools.pairwise(steps):
        saved = ntfs.refresh_paths(saved, ntfs.path_changes(before, after))
        want = {r["usn"]: r["parent_path"] for r in ntfs.journal_paths(records, after).collect()}
        assert {r["usn"]: r["parent_path"] for r in saved.collect()} == want
    assert {r["entry"] for r in ntfs.path_changes(steps[1], steps[2]).collect()} == {900, 901, 902}


def test_journal_links_of_folders_with_many_records(spark):
    """Folders of one, several or no directory record, in several slots of the journal, against a plain search; no window reads ahead."""
    from traceloom.operators import ntfs

    draw = random.Random(8)
    usns = sorted(draw.sample(range(1 << 23), 600))
    rows = [(u, draw.choice([5, *range(40, 52)]), 1, draw.choice([5, 5, 5, *range(40, 60)]), draw.choice([1, 1, 2]), f"n{u}", draw.random() < 0.1) for u in usns]
    rows += [(u + (1 << 24), 70, 1, 5, 1, f"n{u}", True) for u in usns[:1]] + [(1 << 25, 71, 1, 70, 1, "f", False)]
    records = spark.createDataFrame(rows, "usn long, entry long, seq int, parent_entry long, parent_seq int, name string, is_dir boolean")
    want = {}
    for u, _, _, k, s, _, _ in rows:
        named = sorted((r[0], r[5]) for r in rows if r[6] and r[1:3] == (k, s))
        want[u] = ([n for at, n in named if at <= u][-1:] or [n for _, n in named][:1] or [None])[0]
    linked = ntfs.journal_parents(records)
    assert {r["usn"]: r["parent_name"] for r in linked.collect()} == want and linked.count() == len(rows)
    assert "unboundedfollowing" not in plan(linked).lower()


@pytest.mark.parametrize("later", [False, True])
def test_paths_of_a_folder_with_very_many_records(spark, monkeypatch, later):
    """Records in the root and in a folder that only the table knows are linked without a window that reads ahead of each of them."""
    from traceloom.operators import ntfs

    written = []
    monkeypatch.setattr(ntfs, "materialize", lambda df, name, to=ntfs.materialize: written.append(plan(df)) or to(df, name))
    k = F.col("id")
    records = spark.range(2000).select(k.alias("usn"), (k + 1000).alias("entry"), F.lit(1).alias("seq"), F.when(k % 2 == 0, 5).otherwise(900).cast("long").alias("parent_entry"), F.lit(1).alias("parent_seq"), F.lit("f").alias("name"), F.lit(False).alias("is_dir"))
    table = spark.createDataFrame([(900, 5, "t")], "entry long, parent long, name string")
    found = ntfs.refresh_paths(ntfs.saved_paths(records), ntfs.path_changes(None, table)) if later else ntfs.journal_paths(records, table)
    assert {(r["parent_path"], r["count"]) for r in found.groupBy("parent_path").count().collect()} == {(".", 1000), (".\\t", 1000)}
    assert written and not any("unboundedfollowing" in x.lower() for x in written)


class Held:
    """A state of any kind, and the timers, as a stateful processor sees them."""

    def __init__(self):
        self.kept, self.timers = {}, set()
        self.getListState = self.getMapState = self.getValueState = lambda *a: Held()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def get(self):
        return self.kept.get(None)

    def update(self, value):
        self.kept[None] = value

    put = update

    def clear(self):
        self.kept.clear()

    def appendList(self, rows):
        self.kept[None] = [*self.kept.get(None, []), *rows]

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]

    def keys(self):
        return iter(list(self.kept))


@pytest.mark.parametrize("steps", [[10**9], [2000, 2001, 5500, 9000, 9001, 10**9]])
def test_a_key_of_a_stream_has_one_timer(steps):
    """Thousands of events of a key wake it up once a watermark, not once an event, and give the same sessions."""
    import pandas as pd

    from traceloom.streaming.sessions import RemoteSessions

    draw, processor, held = random.Random(5), RemoteSessions(1000), Held()
    rows = [(s * 4_000_000 // 3, draw.choice((4624, 21, 23, 24, 4672)), draw.choice("AB"), draw.choice(("1", None))) for s in range(9000)]
    processor.init(held)
    for part in (rows[1::2], rows[::2]):
        list(processor.handleInputRows(("T", "u"), iter([pd.DataFrame(part, columns=["at", "event_id", "source", "session_id"])]), None))
    given, woken = [], 0
    for second in steps:
        class Now:
            getCurrentWatermarkInMs = staticmethod(lambda s=second: s * 1000)

        while due := sorted(t for t in held.timers if t <= second * 1000):
            woken += 1
            given += [r for pdf in processor.handleExpiredTimer(("T", "u"), Now, None) for r in pdf.itertuples(index=False)]
            held.timers.discard(due[0])
    state, want = dict.fromkeys(c.split()[0] for c in processor.STATE.split(", ")) | {"n": 0, "ids": "", "admin": False}, []
    for e in rows:
        processor._take(state, e, ("T", "u"), want)
    want.append(processor._given(state, ("T", "u")))
    assert [tuple(g) for g in given] == want and sum(g.n for g in given) == 9000 and woken <= len(steps) and not held.timers


@pytest.mark.parametrize("cyclic", [False, True])
def test_depths_without_lists(spark, monkeypatch, cyclic):
    """Chains, bushy trees, missing parents and cycles have the depth and root that lists of ancestors give; trees need no list."""
    draw = random.Random(3)
    edges = [(k, k - 1 if k % 300 else None) for k in range(600)] + [(1000 + k, 1000 + draw.randrange(k) if k else None) for k in range(200)] + [(2000, 7777), (2001, 2000)]
    if cyclic:
        edges += [(3000 + k, 3000 + (k + 1) % 7) for k in range(7)] + [(3100, 3003), (3101, 3100), (3200, 3200), (3201, 3200)]
    table = spark.createDataFrame(edges, "id long, parent_id long")
    shown = lambda df: sorted(tuple(r) for r in df.select("id", "depth", "root").collect())
    want = shown(process.ancestors(table))
    widths = []
    monkeypatch.setattr(process, "materialize", lambda df, name, to=process.materialize: widths.append("array" in str(dict(df.dtypes))) or to(df, name))
    assert shown(process.depths(table)) == want and len(want) == len(edges) and any(widths) == cyclic and len(widths) > 5
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_file_table_parses_its_records_once(spark):
    """The table's plan reads parsed records; names, paths and rows don't each parse the raw ones again."""
    from traceloom.plans.registry import QUERIES

    shown = plan(QUERIES["file_table"](spark, DATA))
    assert "MapInPandas" not in shown and "file-records" in shown


def test_long_needles_have_long_anchors(spark):
    """Needles of all lengths at all places, with repeats and wide letters, each (text, needle) once; long needles meet few other texts."""
    draw = random.Random(9)
    texts = ["".join(draw.choice("abé1 ") for _ in range(draw.randrange(60))) for _ in range(150)] + ["aaaaaaaaaaaa", "xaaaaaaaaaaaaa", "\U0001f600" * 3 + "abcabcabc"]
    needles = sorted({t[k : k + n] for t in texts[::3] + texts[-3:] for n in (1, 3, 4, 5, 6, 7, 9) for k in (0, 1, 2, 5) if t[k : k + n]} | {"zzzzzzz"})
    rows, table = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(n,) for n in needles], "n string")
    got = grams.containing(rows, "t", table, "n")
    assert sorted((r["k"], r["n"]) for r in got.select("k", "n").collect()) == sorted((k, n) for k, t in enumerate(texts) for n in needles if n in t)
    only = grams.containing(rows, "t", table.where("length(n) >= 6"), "n")
    assert ".{6}" in plan(only) and ".{4}" not in plan(only) and sorted(got.columns) == ["k", "n", "t"] == sorted(only.columns)
