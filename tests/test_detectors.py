"""Boundaries of the detectors."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.operators import aggregate, annotate, ioc, process, temporal
from traceloom.streaming.windows import stream_histogram

T0 = datetime.datetime(2024, 1, 1)


def at(spark, seconds, **more):
    rows = [(T0 + datetime.timedelta(seconds=s), *(v[k] for v in more.values())) for k, s in enumerate(seconds)]
    return spark.createDataFrame(rows, ", ".join(["ts timestamp", *(f"{k} string" for k in more)]))


def test_gap_threshold_is_strict(spark):
    assert temporal.gaps(at(spark, [0, 3600]), "ts", 60).count() == 0
    assert temporal.gaps(at(spark, [0, 3660]), "ts", 60).count() == 1


def test_burst(spark):
    times = [300 * k for k in range(4)] + [1200 + k for k in range(6)] + [1500 + k for k in range(6)]
    row = temporal.bursts(at(spark, times), "ts", 5, 5).collect()
    assert [(r["n"], r["factor"]) for r in row] == [(12, 6.0)]


def test_brute_force(spark):
    run = lambda s: temporal.brute_force(at(spark, s, k=["a"] * len(s)), ["k"], "ts").count()
    assert run([0, 60, 120, 300]) == 0 and run([0, 60, 120, 200, 300]) == 1 and run([0, 60, 120, 200, 301]) == 0


def test_spray(spark):
    run = lambda s, t: temporal.password_spray(at(spark, s, src=["a"] * len(s), dst=t), "src", "dst", "ts").count()
    assert run([0, 60, 1800], ["x", "y", "z"]) == 1 and run([0, 60, 1800], ["x", "y", "x"]) == 0


def test_chain_rule_ties_keep_the_first(spark):
    rules = spark.createDataFrame([(0, "a.exe", "b.exe", 2, "one [T1000]"), (1, "A.EXE", "b", 2, "two")], "position int, parent string, child string, level int, reason string")
    row = process.chain_rule_table(rules).collect()
    assert [(r["chain_reason"], r["techniques"]) for r in row] == [("one", "T1000")]


def test_census_of_the_chain_rules(spark):
    import collections

    table = process.chain_rule_table(process.default_rules(spark)).collect()
    assert len(table) == 327 and collections.Counter(r["chain_level"] for r in table) == {3: 116, 2: 117, 1: 69, 0: 25}
    assert all(r["techniques"] and r["chain_reason"] == f"{r['parent_key']} started {r['child_key']}" for r in table)
    rows = spark.createDataFrame([(1, "C:\\cmd.exe", "C:\\rclone.exe", "")], "id int, parent_image string, image string, command string")
    assert [(r["level"], r["techniques"]) for r in process.assess(rows, process.default_rules(spark)).collect()] == [(3, "T1567.002")]


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, parent_id int")
    assert process.ancestors(edges).count() == 3


def test_deep_trees_and_tails_of_cycles(spark):
    from traceloom.operators import ntfs

    deep = {r["id"]: (r["depth"], r["root"]) for r in process.ancestors(spark.createDataFrame([(k, k - 1 if k else None) for k in range(151)], "id int, parent_id int")).collect()}
    assert deep == {k: (k, 0) for k in range(151)}
    tail = {r["id"]: r["ancestors"] for r in process.ancestors(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1)], "id int, parent_id int")).collect()}
    assert tail == {0: [1, 2, 3], 1: [2, 3], 2: [3, 1], 3: [1, 2]}
    folders = spark.createDataFrame([(k, k - 1, f"d{k}") for k in range(6, 156)], "entry long, parent long, name string")
    paths = {r["entry"]: r["path"] for r in ntfs.parent_paths(folders).collect()}
    assert paths[155] == ".\\" + "\\".join(f"d{k}" for k in range(6, 156))


def test_chains_round_a_cycle_and_repeated_pairs(spark):
    from traceloom.operators import lateral

    run = lambda hops: lateral.chains(spark.createDataFrame(hops, "source string, target string, first_ts int"))
    round_trip = run([("X", "S", 1), ("S", "T", 2), ("T", "U", 3), ("U", "X", 4)])
    assert sorted(r["path"] for r in round_trip.collect()) == ["S>T>U>X", "X>S>T>U"]
    assert {r["host"]: r["chains"] for r in lateral.pivots(round_trip).collect()} == {"S": 1, "T": 2, "U": 1}
    assert [tuple(r) for r in run([("A", "B", 10), ("B", "C", 9), ("B", "C", 11)]).collect()] == [("A>B>C", 2, 10, 11, False)]


def test_empty_tables(spark):
    none = at(spark, [0]).limit(0)
    for df in (temporal.sessions(none, "ts"), temporal.gaps(none, "ts"), temporal.bursts(none, "ts"), aggregate.histogram(none, "ts")):
        assert df.count() == 0


def test_infer_types(spark):
    df = spark.createDataFrame([("2024-01-01", "4624", "x", "45566"), ("2024-01-02", "1", "", "45567")], "a string, EventID string, t string, logdate string")
    assert {r["column"]: r["kind"] for r in aggregate.infer_types(df).collect()} == {"a": "timestamp", "EventID": "numeric", "t": "text", "logdate": "timestamp"}


def test_suppression(spark):
    rows = [(1, "C:\\a.exe", "C:\\p.exe", "h1", "u", "a -x 1"), (2, "C:\\a.exe", "C:\\p.exe", "h2", "u", "a -y 2"), (3, "C:\\b.exe", None, None, None, None)]
    found = spark.createDataFrame(rows, "id int, image string, parent_image string, host string, user string, command string").withColumn("reason", F.lit("x"))
    names = "process string, parent string, host string, user string, image_path string, command_contains string, reason string"
    left = lambda *rules: sorted(r["id"] for r in annotate.suppress(found, spark.createDataFrame(list(rules), names)).collect())
    assert left(("A.exe", "", "h1", "", "", "", "known good")) == [2, 3] and left(("", "", "", "", "", "-Y", "r")) == [1, 3]
    assert left(("", "", "", "", "", "", "only a reason")) == [1, 2, 3] and left() == [1, 2, 3]
    assert left(("", "P.EXE", "", "U", "c:\\A.exe", "", "r"), (None, None, None, None, None, "zzz", None)) == [3]
    assert annotate.suppress(found.select("id"), spark.createDataFrame([("r",)], "reason string")).count() == 3


def test_indicators_are_prepared_and_tagged(spark):
    made = ioc.prepare(spark.createDataFrame([("evil[.]com",), ("EVIL.com",), ("# no",), ("",)], "ioc string"))
    assert [r["category"] for r in made.collect()] == ["Domain"]
    hits = ioc.match(spark.createDataFrame([(1, "see Evil.Com/x")], "id long, t string"), made, ["t"], "id")
    assert ioc.hit_tags(hits).first()["rowid"] == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 200_000), min_size=1, max_size=30))
def test_sessions_hold_every_row(spark, seconds):
    assert temporal.sessions(at(spark, seconds), "ts", 60).agg(F.sum("n")).first()[0] == len(seconds)


def test_stream(spark, tmp_path):
    at(spark, [0, 10, 7200]).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_histogram(events, "ts").writeStream.outputMode("complete").format("memory").queryName("hist").start()
    try:
        q.processAllAvailable()
        assert sorted(r["n"] for r in spark.sql("SELECT n FROM hist").collect()) == [1, 2]
    finally:
        q.stop()


def test_full_text_words(spark):
    from traceloom.operators.filters import search

    rows = spark.createDataFrame([(1, "Token, example"), (2, "tokens exam"), (3, "a token's end"), (4, None), (5, "pre_token-Über"), (6, "")], "id int, t string")
    found = lambda term: sorted(r["id"] for r in rows.where(search(["t"], term, "fts")).select("id").collect())
    assert found("token") == [1, 3, 5] and found("tok*") == [1, 2, 3, 5] and found("token exa*") == [1]
    assert found('"token example"') == [1] and found('"token s end"') == [3] and found("über") == [5]
    assert found("c++") == [] and found('""') == [] and found("a.*") == [3] and found("token's") == [3]


def test_full_text_is_by_row(spark):
    from traceloom.operators.filters import search

    rows = spark.createDataFrame([(1, "cmd.exe ran", "host alpha"), (2, "alpha", "beta"), (3, "cmdexe", "10.0.0.1 C:\\Temp\\x.dll")], "id int, a string, b string")
    found = lambda term: sorted(r["id"] for r in rows.where(search(["a", "b"], term, "fts")).select("id").collect())
    assert found("cmd.exe") == [1] and found('"cmd.exe"') == [1] and found("cmd alpha") == [1] and found("alpha beta") == [2]
    assert found('cmd "host alpha"') == [1] and found('"alpha host"') == [] and found("10.0.0.1") == [3] and found("temp\\x.dll") == [3] and found("alpha") == [1, 2]


def test_spray_counts_targets_like_sets(spark):
    import random

    draw = random.Random(4)
    rows = [(k, draw.choice("ab"), draw.choice(["x", "y", "z", "w", None]), T0 + datetime.timedelta(seconds=draw.randrange(0, 400) * 10)) for k in range(250)]
    df = spark.createDataFrame(rows, "id int, src string, dst string, ts timestamp")
    got = {r["id"]: r["n_targets"] for r in temporal.password_spray(df, "src", "dst", "ts", 2, 300).collect()}
    want = {i: len({d for _, s2, d, t2 in rows if s2 == s and d is not None and 0 <= (t - t2).total_seconds() <= 300}) for i, s, _, t in rows}
    assert got == {i: n for i, n in want.items() if n >= 2}


def test_view_keeps_totals_and_four_searches(spark):
    from traceloom.operators.filters import QuerySpec, View

    view = View(spark.createDataFrame([(k, f"word{k % 6}") for k in range(60)], "id int, t string"))
    specs = [QuerySpec(term=f"word{k}", mode="fts") for k in range(6)]
    assert [view.total(s) for s in specs] == [10] * 6 and len(view._rows) == 4 and view.total(specs[0]) == 10
    assert view.rows(specs[5]) is view.rows(specs[5]) and view.total(QuerySpec(term="word1", search_off=True)) == 60
    assert view.total(QuerySpec().with_value("t", "word1")) == 10 and view.total(QuerySpec().with_value("t", "word1", keep=False)) == 50


def test_journal_paths(spark):
    from traceloom.operators import ntfs

    rows = [(1, 40, 1, 30, 1, "a", True), (2, 41, 1, 40, 1, "b", True), (3, 50, 1, 41, 1, "f.txt", False), (4, 40, 2, 5, 5, "new", True), (5, 51, 1, 40, 2, "g.txt", False), (6, 52, 1, 99, 1, "h.txt", False), (7, 53, 1, 5, 5, "i.txt", False)]
    records = spark.createDataFrame(rows, "usn long, entry long, seq int, parent_entry long, parent_seq int, name string, is_dir boolean")
    paths = lambda mft: {r["usn"]: r["parent_path"] for r in ntfs.journal_paths(records, mft).collect()}
    alone = paths(None)
    assert alone[3] == ".\\[ORPHAN]\\a\\b" and alone[5] == ".\\new" and alone[6] == ".\\[ORPHAN]" and alone[7] == "."
    table = paths(spark.createDataFrame([(30, 5, "top"), (99, 30, "low")], "entry long, parent long, name string"))
    assert table[3] == ".\\top\\a\\b" and table[6] == ".\\top\\low" and table[2] == ".\\top\\a" and table[5] == ".\\new"


def test_timestomping_looks_at_four_times_and_keeps_copies(spark):
    from traceloom.operators import ntfs

    day = 86_400 * 10**7
    fn = [1000 * day + 1] * 4
    rows = [(1, "a.txt", ".\\u", *[x + 5 for x in fn], *fn), (2, "a.txt", ".\\u", fn[0] - 1, fn[1] - 60 * day, fn[2], fn[3], *fn), (3, "a.exe", ".\\Windows\\WinSxS\\x", *fn[:3], fn[3] - 2 * day, *fn), (4, "z.txt", ".\\u", fn[0] - 1 + day, *[fn[0] + day] * 3, *fn)]
    names = ", ".join(f"{p}_{k} long" for p in ("si", "fn") for k in ntfs.TIMES)
    got = ntfs.timestomping(spark.createDataFrame(rows, f"entry int, name string, path string, {names}"))
    assert {r["entry"]: (r["si_before_fn"], r["zero_subsecond"], r["copied"], r["severity"], r["suppressed"]) for r in got.collect()} == {2: (True, False, True, "high", False), 3: (True, False, False, "critical", True), 4: (False, True, False, "low", False)} | ({2: (True, True, True, "high", False)} if (fn[0] - 1) % 10**7 == 0 else {})
    assert tuple(ntfs.timestomp_summary(got).first()) == (2, 1, 1, 1)


def test_chains_that_are_cut_say_so(spark):
    from traceloom.operators import lateral

    line = spark.createDataFrame([(f"h{k}", f"h{k + 1}", k) for k in range(12)], "source string, target string, first_ts int")
    whole = lateral.chains(line).collect()
    assert [(r["hops"], r["cut"]) for r in whole] == [(12, False)]
    assert all(r["cut"] == (r["path"].split(">")[-1] != "h12") for r in lateral.chains(line, 3).collect())


def test_patterns_and_many_indicators(spark):
    rows = spark.createDataFrame([(1, "beacon to a1.evil.net"), (2, "nothing"), (3, "A2.EVIL.NET and 10.0.0.9")], "id long, t string")
    hits = ioc.match_patterns(rows, [r"a\d\.evil\.net", r"10\.0\.0\.\d", "zzz"], ["t"], "id", batch=2)
    assert sorted((r["row"], r["iocs"]) for r in ioc.row_map(hits).collect()) == [(1, [r"a\d\.evil\.net"]), (3, [r"10\.0\.0\.\d", r"a\d\.evil\.net"])]
    names = spark.createDataFrame([("a1.evil.net",), ("EVIL",), ("evil",), ("0.0.9",), ("none",), ("",)], "ioc string")
    want = sorted([("a1.evil.net", 1), ("EVIL", 1), ("evil", 1), ("EVIL", 3), ("evil", 3), ("0.0.9", 3)])
    for at_once in (2, 50):
        assert sorted((r["ioc"], r["row"]) for r in ioc.match(rows, names, ["t"], "id", at_once).collect()) == want
    assert ioc.match(rows, names.limit(0), ["t"], "id").count() == 0


def test_journal_narrative(spark):
    from traceloom.operators import ntfs

    rows = spark.createDataFrame([("deletions", ".\\a", T0), ("deletions", ".\\a", T0), ("deletions", None, T0), ("close patterns", ".\\b", T0)], "category string, parent_path string, ts timestamp")
    findings = ntfs.journal_findings(rows)
    assert [(r["category"], r["n"], r["folders"], r["top_folder"], r["rank"]) for r in findings.orderBy("rank").collect()] == [("deletions", 3, 2, ".\\a", 1), ("close patterns", 1, 1, ".\\b", 2)]
    told = ntfs.journal_narrative(findings).first()["narrative"]
    assert told == "3 deletions records in 2 folders from 2024-01-01 00:00:00 to 2024-01-01 00:00:00, most of them in .\\a."
    assert ntfs.journal_narrative(ntfs.journal_findings(rows.limit(0))).first()["narrative"] == ""


def test_verdicts_of_long_numbers_with_a_port(spark):
    iocs = spark.createDataFrame([("10.1500.3.4:443",), ("10.15.3.4:443",), ("10.1500.3.4:443/x",), ("[FE80::1]:443",)], "ioc string")
    verdicts = spark.createDataFrame([("10.1500.3.4", 0, 2, 80), ("10.15.3.4", 1, 0, 80)], "key string, malicious int, suspicious int, total int")
    got = {r["ioc"]: r["verdict"] for r in ioc.enrich(iocs, verdicts).collect()}
    assert got == {"10.1500.3.4:443": "suspicious", "10.15.3.4:443": "malicious", "10.1500.3.4:443/x": "not_found", "[FE80::1]:443": "not_found"}
