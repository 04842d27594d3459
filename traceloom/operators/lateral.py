"""Lateral movement: noise, edges, findings, sessions, chains and host names."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .temporal import carried, seconds

# Fixed values: (event id, rule, severity, whether it makes an edge).
RULES = (
    (1149, "Network Authentication", "High", True), (21, "Session Logon", "Medium", True), (22, "Shell Start Notification", "Low", True), (23, "Session Logoff", "Low", False), (24, "Session Disconnected", "Low", False), (25, "Session Reconnected", "Medium", True), (39, "Disconnect by Other / Reason", "Low", False), (40, "Disconnect by Other / Reason", "Low", False),
    (4624, "Successful Logon", "High", True), (4625, "Failed Logon", "High", True), (4648, "Explicit Credentials (RunAs)", "High", True), (4672, "Admin Privileges Assigned", "High", False), (4778, "Session Reconnect / Disconnect", "Medium", True), (4779, "Session Reconnect / Disconnect", "Medium", False), (4634, "Account Logoff", "Low", False), (4647, "Account Logoff", "Low", False),
)
NOISE_USERS = r"(?i)^(system|local service|network service|anonymous logon|dwm-.*|umfd-.*|.*\$)$"
NOISE_SOURCES = ("", "-", "0.0.0.0", "::1", "127.0.0.1", "localhost")
OUTLIER_HOST = r"(?i)^(desktop-[a-z0-9]{5,}|win-[a-z0-9]{5,}|kali|parrot|user-pc|yourname|admin|test|hacker|attacker|root|win10|win11|owner-pc|localhost)$"
SUSPICIOUS_HOST = r"(?i)(vps|^desktop-[a-z0-9]{7}$|^win-[a-z0-9]{8,}$|^winvm)"
REMOTE_TOOLS = r"(?i)(screenconnect|anydesk|teamviewer|atera|netsupport|splashtop|rustdesk|pdq connect|meshagent|meshcentral|action1|ammyy|remote utilities|simplehelp|tacticalrmm|fleetdeck|level\.io|dwservice|isl online|hoptodesk|lite manager|ultravnc|tigervnc|radmin|zoho assist|pulseway|labtech|automate|kaseya|n-able|solarwinds|goto resolve|logmein|beyondtrust|bomgar|dameware|supremo|fixme\.it)"
TUNNELS = r"(?i)(ngrok|tailscale|cloudflared|chisel|\bfrpc?\b|ligolo|wireguard)"
# (variant, pattern) of remote-execution traces in command lines and service binaries.
REMOTE_EXECUTION = (
    ("smbexec", r"(?i)cmd(\.exe)? /q /c .*\\\\127\.0\.0\.1\\(admin|c)\$\\__output|__output|%comspec% .*\.bat|btobto"), ("wmiexec", r"(?i)cmd(\.exe)? /q /c .*\\\\127\.0\.0\.1\\admin\$"), ("dcomexec", r"(?i)mmc(\.exe)? .*-embedding"),
    ("atexec", r"(?i)\\temp\\[a-z0-9]+\.tmp 2>&1|2015-07-15t20:35:13"), ("psexec", r"(?i)remcom_(communicat|stdin|stdout|stderr)|psexesvc"),
)
COMMON_WORDS = ("disk", "bits", "dhcp", "wmsvc", "audio", "spool", "fonts", "power", "themes", "server", "browser", "netlogon", "system", "update", "windows", "service", "spooler", "storage", "network", "session")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "event_id int, rule string, severity string, makes_edge boolean")


def relevant(logons: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rows (event_id, ts, source, target, user, ...) with a rule, without noise; each with rule, severity and makes_edge.

    A rule table with a column `pattern` has rules of its own: where it is filled, the row's `payload` must match it.
    """
    rules = rules if rules is not None else rule_table(logons.sparkSession)
    quiet = ~F.coalesce(F.col("source"), F.lit("")).isin(*NOISE_SOURCES) & ~F.coalesce(F.col("user"), F.lit("")).rlike(NOISE_USERS)
    found = logons.where(quiet).join(rules, "event_id")
    if "pattern" not in rules.columns:
        return found
    return found.where(F.coalesce(F.col("pattern") == "", F.lit(True)) | F.rlike(F.coalesce("payload", F.lit("")), F.col("pattern"))).drop("pattern")


def edge_event_counts(logons: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, user, logon_type) with counts of each event id: first by id, then as one map an edge."""
    edge = ["source", "target", "user", "logon_type"]
    per = relevant(logons, rules).where("makes_edge").groupBy(*edge, "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_id", "n"))))
    return per.groupBy(*edge).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), counts.alias("by_event"))


def logon_edges(logons: DataFrame) -> DataFrame:
    """Edges (source, target, user, logon_type) with counts, times, event ids and whether a password went in clear text."""
    grouped = relevant(logons).where("makes_edge").groupBy("source", "target", "user", "logon_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set(F.col("event_id").cast("string"))), ",").alias("event_ids"))
    return out.withColumn("clear_text", F.col("logon_type") == 8)


def chains(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Maximal simple paths of hops in time order: (path, hops, first_ts, last_ts, cut); edges: (source, target, first_ts).

    Times of a host pair are all kept: a path takes the earliest time of its first pair and then each pair's earliest one
    that is not before the last, so it is found if any times fit. Paths begin at every pair, and those that are the
    beginning or the end of a longer one are dropped. Each round joins the paths with the next pairs and is written;
    rounds end when no path grows, or after max_hops hops: then paths that would go on are given as far as they are, with
    cut true.
    """
    hops = edges.where("source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set("first_ts")).alias("times")).where(F.size("times") > 0)
    hops = materialize(hops, "hops")
    paths, out = hops.select(F.array("source", "target").alias("path"), F.col("times")[0].alias("first_ts"), F.col("times")[0].alias("last_ts"), F.col("target").alias("end")), None
    step = hops.select(F.col("source").alias("end"), F.col("target").alias("to"), "times")
    for k in itertools.count(1):
        later = F.array_min(F.filter("times", lambda t: t >= F.col("last_ts")))
        grown = paths.join(step, "end").where(~F.array_contains("path", F.col("to"))).withColumn("next_at", later).where("next_at IS NOT NULL")
        longer = materialize(grown.select(F.concat("path", F.array("to")).alias("path"), "first_ts", F.col("next_at").alias("last_ts"), F.col("to").alias("end")), "paths")
        last = k == max_hops or longer.isEmpty()
        if k == max_hops:
            more = longer.select(F.slice("path", 1, k + 1).alias("path")).distinct().withColumn("goes_on", F.lit(True))
            done = paths.join(more, "path", "left").withColumn("cut", F.coalesce("goes_on", F.lit(False)))
        else:
            parts = longer.select(F.explode(F.array(F.slice("path", 1, k + 1), F.slice("path", 2, k + 1))).alias("path")).distinct()
            done = paths.join(parts, "path", "left_anti").withColumn("cut", F.lit(False))
        done = done.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), "first_ts", "last_ts", "cut")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        paths = longer


def chain_labels(hops: DataFrame, keep: int = 4, max_hops: int | None = None, salt_rows: int = 1_000_000) -> DataFrame:
    """(host, hops, arrives, path): the `keep` earliest arrivals at every host after each number of hops.

    hops: (source, target, ts). Labels spread in time: round k extends the labels of k hops by every later or simultaneous
    hop to a host that their path has not, keeps a host's earliest arrivals (ties by path) and drops the others, which
    cannot be extended where an earlier one cannot. So a round holds at most `keep` labels a host, however many paths
    there are, and rounds end with the longest chain (or max_hops). A label is a path that fits in time; with `keep` large
    enough all of them are there. Sources with very many hops are dealt to several tasks, salt_rows each.
    """
    steps = hops.where("source <> target AND ts IS NOT NULL").select("source", "target", "ts").distinct()
    degree = steps.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("salts"))
    steps = materialize(steps.join(degree, "source").withColumn("salt", F.pmod(F.xxhash64("target"), F.col("salts")).cast("int")), "hops")
    salts = materialize(degree, "salts")
    best = Window.partitionBy("host").orderBy("arrives", "path")
    first = steps.groupBy("source", "target").agg(F.min("ts").alias("arrives")).select(F.col("target").alias("host"), F.lit(1).alias("hops"), "arrives", F.array("source", "target").alias("path"))
    found, count = first, 1
    out: DataFrame | None = None
    while True:
        kept = materialize(found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= keep).drop("k"), "labels")
        if kept.isEmpty():
            return kept if out is None else out
        out = kept if out is None else out.unionByName(kept)
        if count == max_hops:
            return out
        ready = kept.join(salts, kept["host"] == salts["source"]).select("path", "arrives", F.col("host").alias("source"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        meets = steps.drop("salts").join(ready, ["source", "salt"]).where((F.col("ts") >= F.col("arrives")) & ~F.array_contains("path", F.col("target")))
        count += 1
        found = meets.groupBy("target", "path").agg(F.min("ts").alias("arrives")).select(F.col("target").alias("host"), F.lit(count).alias("hops"), "arrives", F.concat("path", F.array("target")).alias("path"))


def longest_chains(hops: DataFrame, keep: int = 4, max_hops: int | None = None) -> DataFrame:
    """(host, hops, arrives, path): for each host the longest chain that ends there, the earliest of equal ones."""
    order = F.struct((-F.col("hops")).alias("h"), "arrives", "path")
    best = chain_labels(hops, keep, max_hops).groupBy("host").agg(F.min(order).alias("b"))
    return best.select("host", (-F.col("b.h")).alias("hops"), "b.arrives", F.array_join("b.path", ">").alias("path"))


def stats_cards(edges: DataFrame, findings: DataFrame, sessions: DataFrame, paths: DataFrame, events: DataFrame) -> DataFrame:
    """One row: findings, hosts, connections, users, sessions, the longest chain, outlier hosts and analysed events."""
    hosts = edges.select(F.explode(F.array("source", "target")).alias("host")).groupBy("host").agg(F.lit(1).alias("one"))
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        counted(findings, "findings"), hosts.agg(F.count(F.lit(1)).alias("hosts"), F.count_if(host_tier(F.col("host")) > 0).alias("outliers")),
        edges.agg(F.count_distinct("source", "target").alias("connections"), F.count_distinct("user").alias("users")), counted(sessions, "sessions"),
        paths.agg(F.coalesce(F.max("hops"), F.lit(0)).alias("longest_chain")), counted(events, "events"),
    ]
    return functools.reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def pivots(paths: DataFrame) -> DataFrame:
    """Hosts in the middle of a chain, with the number of chains."""
    hosts = F.split("path", ">")
    return paths.where("hops >= 2").select(F.explode(F.slice(hosts, 2, F.size(hosts) - 2)).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("chains"))


def host_tier(name: Column) -> Column:
    """1 outlier, 2 suspicious, 0 neither."""
    return F.when(name.rlike(OUTLIER_HOST) | name.rlike(r"[^\x00-\x7F]"), 1).when(name.rlike(SUSPICIOUS_HOST), 2).otherwise(0)


def remote_execution(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for variant, pattern in reversed(REMOTE_EXECUTION):
        out = F.when(text.rlike(pattern), F.lit(variant)).otherwise(out)
    return out


def random_service_name(name: Column) -> Column:
    """The variant that a service's name of 4 or 7 letters suggests, unless it is a common word."""
    odd = ~F.lower(name).isin(*COMMON_WORDS)
    return F.when(name.rlike("^[A-Za-z]{4}$") & odd, "psexec").when(name.rlike("^[A-Za-z]{7}$") & odd, "smbexec")


def remote_tool(text: Column) -> Column:
    return F.when(text.rlike(REMOTE_TOOLS), "rmm").when(text.rlike(TUNNELS), "tunnel")


ADMIN_WITHIN, ACTIVE_WITHIN, CLOSE_WITHIN = 5, 30, 60  # fixed values: seconds that a session's events may lie apart


def rdp_sessions(events: DataFrame, close_within: int | None = CLOSE_WITHIN) -> DataFrame:
    """Sessions of (target, user): a logon or reconnect opens a new one if it is over 30 s after the last such event, if
    its source or session id is known and another one than the last known, or if the session was closed.

    events: (event_id, ts, source, target, user) and, if there is one, session_id. Events without a source or session id
    belong to the session they fall in. A privilege event (4672) marks a session only within 5 s of its last opening
    event. A disconnect or logoff belongs to the session whose id or source it names; one that names neither, or others,
    belongs to it only within close_within seconds of its last event (None: always) and else is a session of its own.
    Sessions are numbered by running values that are carried over slots of time, so a (target, user) with very many events
    is several tasks; one aggregation gives source, session id, times, events and status.
    """
    keys, order = ["target", "user"], ["ts", "event_id"]
    known = lambda c: F.when(~F.coalesce(F.upper(F.trim(c)), F.lit("")).isin("", "-", "LOCAL"), c)
    session_id = F.col("session_id").cast("string") if "session_id" in events.columns else F.lit(None).cast("string")
    rows = events.withColumn("source", known(F.col("source"))).withColumn("session_id", known(session_id))
    opens = F.col("event_id").isin(1149, 21, 25, 4624, 4778)
    closes = F.col("event_id").isin(23, 24, 39, 40, 4634, 4647, 4779)
    before = {"opened": F.when(opens, F.col("ts")), "closed": F.when(closes, F.col("ts")), "last_source": F.when(opens, F.col("source")), "last_ts": F.col("ts")}
    marked = carried(rows.withColumns({"opens": opens, "closes": closes}), keys, order, "ts", before)
    apart = lambda c: seconds(F.col("ts")) - seconds(F.col(c))
    late = F.col("opened").isNull() | (apart("opened") > ACTIVE_WITHIN)
    fresh = F.col("opens") & (late | F.coalesce(F.col("closed") >= F.col("opened"), F.lit(False)) | F.coalesce(F.col("last_source") != F.col("source"), F.lit(False)))
    runs = carried(marked.withColumn("fresh", fresh), keys, order, "ts", sums={"run": fresh.cast("int")})
    named = carried(runs, keys, order, "ts", {"last_id": F.when(F.col("opens") & F.col("session_id").isNotNull(), F.struct("run", "session_id"))})
    current = F.when(F.col("last_id.run") == F.col("run"), F.col("last_id.session_id"))
    split = F.col("fresh") | (F.col("opens") & F.coalesce(current != F.col("session_id"), F.lit(False)))
    if close_within is not None:
        linked = F.coalesce(current == F.col("session_id"), F.lit(False)) | F.coalesce(F.col("last_source") == F.col("source"), F.lit(False))
        split = split | (F.col("closes") & ~linked & (F.col("last_ts").isNull() | (apart("last_ts") > close_within)))
    numbered = carried(named, keys, order, "ts", sums={"session": split.cast("int")})
    has = lambda *ids: F.max(F.col("event_id").isin(*ids).cast("int")) == 1
    admin = F.max(((F.col("event_id") == 4672) & F.coalesce(apart("opened") <= ADMIN_WITHIN, F.lit(False))).cast("int")) == 1
    status = (
        F.when(has(23, 4634, 4647), "ENDED").when(has(24, 39, 40, 4779), "DISCONNECTED").when(has(4625) & ~has(21, 22, 25, 4624, 4778), "FAILED")
        .when(has(21, 22, 25, 4778), F.when(has(22), "ACTIVE").otherwise("NO LOGOFF")).when(F.count(F.lit(1)) == 1, "INCOMPLETE").otherwise("CONNECTING")
    )
    one = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
    return numbered.groupBy("target", "user", "session").agg(one("source"), one("session_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), status.alias("status"), admin.alias("admin"), has(25, 4778).alias("reconnect"))


def session_groups(sessions: DataFrame, many: int = 5) -> DataFrame:
    """The grouped view: (source, target, user, status) with sessions, events, times and whether there are over `many`."""
    grouped = sessions.groupBy("source", "target", "user", "status").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return grouped.withColumn("many", F.col("sessions") > many)
