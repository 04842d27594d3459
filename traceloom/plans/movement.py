"""Queries of lateral movement at size: sessions of all statuses, chains by labels, edges by event id, rules of one's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lateral
from ..streaming.sessions import stateful_store, stream_rdp_sessions, stream_sessions
from . import fixtures
from .registry import query, read
from .scaled import _LOGON, _logons

_EVENT_IDS = (4624, 21, 22, 1149, 4672, 24, 25, 23, 4634, 4625, 4778, 39, 4625, 4625, 4672)

# Six pairs of target and user, an event of each about every 24 seconds; sources and session ids change and may be unknown.
_RDP_ROWS = f"""r AS (SELECT {list(_EVENT_IDS)}[1 + (event_id * event_id + user_id // 6) % {len(_EVENT_IDS)}] AS event_id, to_timestamp(1700000000 + event_id * 4)::TIMESTAMP AS ts,
  'T' || user_id % 3 AS target, 'u' || user_id % 2 AS "user", CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS source, CASE WHEN event_id % 5 > 0 THEN ((event_id // 64) % 3)::VARCHAR END AS session_id FROM events),
o AS (SELECT *, event_id IN (1149, 21, 25, 4624, 4778) AS opens, event_id IN (23, 24, 39, 40, 4634, 4647, 4779) AS closes FROM r),
m AS (SELECT *, last_value(CASE WHEN opens THEN ts END IGNORE NULLS) OVER b AS opened, last_value(CASE WHEN closes THEN ts END IGNORE NULLS) OVER b AS closed, last_value(CASE WHEN opens THEN source END IGNORE NULLS) OVER b AS last_source, lag(ts) OVER (PARTITION BY target, "user" ORDER BY ts, event_id) AS last_ts
  FROM o WINDOW b AS (PARTITION BY target, "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, opens AND (opened IS NULL OR epoch(ts) - epoch(opened) > 30 OR coalesce(closed >= opened, false) OR coalesce(last_source <> source, false)) AS fresh FROM m),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY target, "user" ORDER BY ts, event_id) AS run FROM f),
i AS (SELECT *, last_value(CASE WHEN opens THEN session_id END IGNORE NULLS) OVER (PARTITION BY target, "user", run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM n),
s AS (SELECT *, fresh OR (opens AND coalesce(current <> session_id, false)) OR (closes AND NOT (coalesce(current = session_id, false) OR coalesce(last_source = source, false)) AND (last_ts IS NULL OR epoch(ts) - epoch(last_ts) > 60)) AS split FROM i),
t AS (SELECT *, CAST(sum(split::INT) OVER (PARTITION BY target, "user" ORDER BY ts, event_id) AS BIGINT) AS session FROM s),
g AS (SELECT target, "user", session, arg_min(source, ts) FILTER (WHERE source IS NOT NULL) AS source, arg_min(session_id, ts) FILTER (WHERE session_id IS NOT NULL) AS session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
  CASE WHEN bool_or(event_id IN (23, 4634, 4647)) THEN 'ENDED' WHEN bool_or(event_id IN (24, 39, 40, 4779)) THEN 'DISCONNECTED' WHEN bool_or(event_id = 4625) AND NOT bool_or(event_id IN (21, 22, 25, 4624, 4778)) THEN 'FAILED'
  WHEN bool_or(event_id IN (21, 22, 25, 4778)) THEN CASE WHEN bool_or(event_id = 22) THEN 'ACTIVE' ELSE 'NO LOGOFF' END WHEN count(*) = 1 THEN 'INCOMPLETE' ELSE 'CONNECTING' END AS status,
  bool_or(event_id = 4672 AND coalesce(epoch(ts) - epoch(opened) <= 5, false)) AS admin, bool_or(event_id IN (25, 4778)) AS reconnect FROM t GROUP BY target, "user", session)"""


def _rdp_rows(spark, d):
    e, k, u = read(spark, d, "events"), F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    which = F.get(F.array(*map(F.lit, _EVENT_IDS)), ((k * k + F.floor(u / 6)) % len(_EVENT_IDS)).cast("int"))
    return e.select(
        which.alias("event_id"), F.timestamp_seconds(k * 4 + 1_700_000_000).alias("ts"), F.concat(F.lit("T"), text(u % 3)).alias("target"), F.concat(F.lit("u"), text(u % 2)).alias("user"),
        F.when(u % 4 == 0, "A").when(u % 4 == 1, "B").when(u % 4 == 2, "-").otherwise("LOCAL").alias("source"), F.when(k % 5 > 0, text(F.floor(k / 64) % 3)).alias("session_id"),
    )


@query(f"WITH {_RDP_ROWS} SELECT * FROM g")
def rdp_sessions_mixed(spark, d):
    """Sessions of every status from events of several sources and session ids."""
    return lateral.rdp_sessions(_rdp_rows(spark, d))


@query(f'WITH {_RDP_ROWS} SELECT source, target, "user", status, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, min(first_ts) AS first_ts, max(last_ts) AS last_ts, count(*) > 5 AS many FROM g GROUP BY source, target, "user", status')
def rdp_session_groups(spark, d):
    return lateral.session_groups(lateral.rdp_sessions(_rdp_rows(spark, d)))


_LABELS = """WITH RECURSIVE h AS (SELECT 'H' || user_id % 16 AS source, 'H' || (event_id * 7 + user_id) % 16 AS target, ts FROM events), s AS (SELECT DISTINCT * FROM h WHERE source <> target AND ts IS NOT NULL),
r AS (SELECT host, hops, arrives, path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrives, path) AS k FROM (SELECT target AS host, CAST(1 AS INTEGER) AS hops, min(ts) AS arrives, [source, target] AS path FROM s GROUP BY source, target)) WHERE k <= 4
UNION ALL SELECT host, hops, arrives, path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrives, path) AS k FROM (SELECT s.target AS host, r.hops + 1 AS hops, min(s.ts) AS arrives, list_append(r.path, s.target) AS path
  FROM r JOIN s ON r.host = s.source AND s.ts >= r.arrives AND NOT list_contains(r.path, s.target) GROUP BY s.target, r.hops, r.path)) WHERE k <= 4)"""


def _hops(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    name = lambda c: F.concat(F.lit("H"), (c % 16).cast("string"))
    return read(spark, d, "events").select(name(u).alias("source"), name(k * 7 + u).alias("target"), "ts")


@query(_LABELS + " SELECT host, hops, arrives, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY hops DESC, arrives, path) AS best FROM r) WHERE best = 1")
def longest_chains_events(spark, d):
    """The longest chain to each host in a dense graph of logons with cycles, every user's."""
    return lateral.longest_chains(_hops(spark, d))


@query(_LABELS + " SELECT host, count(*) AS chains FROM (SELECT unnest(path[2 : len(path) - 1]) AS host FROM r WHERE hops >= 2) GROUP BY host")
def chain_pivots_events(spark, d):
    """Hosts in the middle of the chains kept."""
    paths = lateral.chain_labels(_hops(spark, d)).withColumn("path", F.array_join("path", ">"))
    return lateral.pivots(paths)


@query(f"""WITH {_LOGON}, x AS (SELECT source, target, "user", logon_type, eid, count(*) AS n FROM g WHERE source <> '-' AND "user" <> 'SYSTEM' AND eid <> 4672 GROUP BY ALL)
SELECT source, target, "user", logon_type, CAST(sum(n) AS BIGINT) AS n, string_agg(eid || ':' || n, ',' ORDER BY eid) AS by_event FROM x GROUP BY source, target, "user", logon_type""")
def edge_event_counts(spark, d):
    pair = lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))
    rows = lateral.edge_event_counts(_logons(spark, d))
    return rows.select("source", "target", "user", "logon_type", "n", F.array_join(F.transform(F.map_entries("by_event"), pair), ",").alias("by_event"))


@query(f"""WITH {_LOGON}, x AS (SELECT g.*, e.event_type AS payload FROM g JOIN events e USING (event_id))
SELECT event_id AS id, CASE WHEN eid = 4625 THEN 'Failure' ELSE 'Odd logon' END AS rule FROM x WHERE source <> '-' AND "user" <> 'SYSTEM' AND (eid = 4625 OR eid = 4624 AND regexp_matches(payload, '^(error|signup)$'))""")
def lateral_custom_rules(spark, d):
    """Rules of one's own, one with a pattern on the payload."""
    rules = spark.createDataFrame([(4625, "Failure", "Low", True, ""), (4624, "Odd logon", "High", True, "^(error|signup)$")], "event_id int, rule string, severity string, makes_edge boolean, pattern string")
    e = read(spark, d, "events")
    k, u = F.col("id"), F.col("user_id")
    rows = e.withColumnRenamed("event_id", "id").select(
        "id", F.when(u % 4 == 0, 4625).when(u % 4 == 1, 4672).otherwise(4624).alias("event_id"), F.when(u % 9 == 0, F.lit("-")).otherwise(F.concat(F.lit("H"), (u % 6).cast("string"))).alias("source"),
        F.concat(F.lit("H"), (k % 5).cast("string")).alias("target"), F.when(u % 10 == 0, F.lit("SYSTEM")).otherwise(F.concat(F.lit("u"), (u % 7).cast("string"))).alias("user"), F.col("event_type").alias("payload"),
    )
    return lateral.relevant(rows, rules).select("id", "rule")


# Streams, replayed from files in order; a last row far in the future lets the watermark pass all others.


def _replayed(spark, rows, end, order: str, made):
    """The rows of a stream made of a table's rows in four files and one row more, in a fifth."""
    path = fixtures.folder(spark, "stream")
    rows.repartitionByRange(4, order).sortWithinPartitions(order).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out, state = fixtures.folder(spark, "streamed"), fixtures.folder(spark, "stream-state")
    made(stream).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out)


@query("""WITH m AS (SELECT event_type AS source, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, coalesce((epoch(minute) - epoch(lag(minute) OVER (PARTITION BY source ORDER BY minute)) > 2400)::INT, 0) AS cut FROM m),
s AS (SELECT *, sum(cut) OVER (PARTITION BY source ORDER BY minute) AS k FROM c) SELECT source, min(minute) AS from_ts, max(minute) AS to_ts, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY source, k""")
def stream_gap_sessions(spark, d):
    """Sessions of each type by silences of 40 minutes, from session windows of a stream."""
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    end = spark.range(1).select(F.lit("2099-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").alias("event_type"))
    return _replayed(spark, rows, end, "ts", lambda s: stream_sessions(s, "ts", "event_type", 40, "60 days"))


@query(f'WITH {_RDP_ROWS} SELECT target, "user", source, session_id, first_ts, last_ts, n, status, admin, reconnect FROM g')
def stream_rdp(spark, d):
    """Remote sessions from a stateful processor, the same as from the batch operator."""
    stateful_store(spark)
    rows = _rdp_rows(spark, d)
    end = spark.range(1).select(F.lit(0).alias("event_id"), F.lit("2099-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").alias("target"), F.lit("").alias("user"), F.lit("").alias("source"), F.lit("").alias("session_id"))
    return _replayed(spark, rows, end.select(*rows.columns), "ts", lambda s: stream_rdp_sessions(s, "1 hour"))
