"""Queries of the timeline operators on the driver's tables, each with the same meaning in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import annotate, temporal
from ..operators import query as Q
from ..operators.filters import Condition, QuerySpec, advanced, pivot_window, search, search_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Temporal analytics.

_WINDOWS = """w AS (SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS window_start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT window_start, n, greatest(median(n) OVER (), 1.0) AS baseline FROM w)"""


@query(f"WITH {_WINDOWS} SELECT window_start, n, CAST(baseline AS DOUBLE) AS baseline, n > 2 * baseline AS is_burst FROM f")
def burst_windows(spark, d):
    return temporal.burst_windows(read(spark, d, "events"), "ts", 5, 2)


@query(f"""WITH {_WINDOWS}, b AS (SELECT *, floor(epoch(window_start) / 300) - row_number() OVER (ORDER BY window_start) AS island FROM f WHERE n > 2 * baseline)
SELECT min(window_start) AS from_ts, max(window_start) + INTERVAL 5 MINUTE AS to_ts, CAST(sum(n) AS BIGINT) AS n, CAST(max(n) / first(baseline) AS DOUBLE) AS factor,
  CAST((epoch(max(window_start)) + 300 - epoch(min(window_start))) / 60 AS BIGINT) AS duration_minutes FROM b GROUP BY island""")
def burst_periods(spark, d):
    return temporal.bursts(read(spark, d, "events"), "ts", 5, 2)


_MINUTES = "m AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_MINUTES}, c AS (SELECT *, CASE WHEN epoch(minute) - epoch(lag(minute) OVER (ORDER BY minute)) > 720 THEN 1 ELSE 0 END AS cut FROM m),
s AS (SELECT *, sum(cut) OVER (ORDER BY minute) + 1 AS session FROM c)
SELECT CAST(session AS BIGINT) AS session, min(minute) AS from_ts, max(minute) AS to_ts, CAST(sum(n) AS BIGINT) AS n, CAST((epoch(max(minute)) - epoch(min(minute))) / 60 AS BIGINT) AS duration_minutes FROM s GROUP BY session""")
def gap_sessions(spark, d):
    return temporal.sessions(read(spark, d, "events"), "ts", 12)


@query(f"""WITH {_MINUTES}, p AS (SELECT lag(minute) OVER (ORDER BY minute) AS from_ts, minute AS to_ts FROM m)
SELECT from_ts, to_ts, CAST((epoch(to_ts) - epoch(from_ts)) / 60 AS BIGINT) AS minutes FROM p WHERE epoch(to_ts) - epoch(from_ts) > 720""")
def gap_gaps(spark, d):
    return temporal.gaps(read(spark, d, "events"), "ts", 12)


@query("SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n_window FROM events WHERE event_type = 'error') WHERE n_window >= 5")
def brute_force_window(spark, d):
    return temporal.brute_force(read(spark, d, "events").where("event_type = 'error'"), ["user_id"], "ts", 5, 86_400).select("event_id", "user_id", "n_window")


@query("SELECT * FROM (SELECT event_id, user_id, CAST(count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 8 HOUR PRECEDING AND CURRENT ROW) AS INTEGER) AS n_targets FROM events) WHERE n_targets >= 3")
def spray_window(spark, d):
    return temporal.password_spray(read(spark, d, "events"), "user_id", "event_type", "ts", 3, 28_800).select("event_id", "user_id", "n_targets")


@query("""WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fail_ts FROM events)
SELECT event_id, user_id, fail_ts FROM m WHERE event_type = 'purchase' AND epoch(ts) - epoch(fail_ts) <= 3600""")
def fail_then_success(spark, d):
    kind = F.col("event_type")
    return temporal.success_after_failure(read(spark, d, "events"), ["user_id"], "ts", kind == "error", kind == "purchase", 3600).select("event_id", "user_id", "fail_ts")


@query("""WITH s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), p AS (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL),
r AS (SELECT p.*, epoch(first_ts) <= epoch(lo) + 0.01::DOUBLE * (epoch(hi) - epoch(lo)) AS early, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS k FROM p, s)
SELECT user_id, event_type, first_ts, early FROM r WHERE early OR k = 1""")
def first_seen(spark, d):
    return temporal.first_seen(read(spark, d, "events"), "user_id", "event_type", "ts")


@query("""SELECT p.event_id, coalesce(v.event_id, -1) AS seen_event FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_parent(spark, d):
    events = read(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(left, events.where("event_type = 'view'"), ["user_id"], "ts", "event_id", "seen_event").select("event_id", F.coalesce("seen_event", F.lit(-1)).alias("seen_event"))


@query("""WITH p AS (SELECT floor(epoch(ts))::BIGINT AS s, count(*) AS n FROM events GROUP BY 1), a AS (SELECT s, sum(n) OVER (ORDER BY s RANGE BETWEEN CURRENT ROW AND 179 FOLLOWING) AS total FROM p)
SELECT to_timestamp(s)::TIMESTAMP AS from_ts, CAST(total AS BIGINT) AS total FROM a ORDER BY total DESC, s LIMIT 1""")
def densest_window(spark, d):
    return temporal.densest_window(read(spark, d, "events"), "ts")


# Aggregations.


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def histogram_hour(spark, d):
    return A.histogram(read(spark, d, "events"), "ts", "hour")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type AS source, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def histogram_day_by_type(spark, d):
    return A.histogram(read(spark, d, "events"), "ts", "day", "event_type")


def _stack_sql(column: str, table: str) -> str:
    return f"WITH g AS (SELECT coalesce({column}::VARCHAR, '') AS value, count(*) AS n FROM {table} GROUP BY 1), s AS (SELECT value, n, n::DOUBLE / (sum(n) OVER ())::DOUBLE AS share FROM g) SELECT value, n, share, share < 0.01 AS rare FROM s ORDER BY n DESC, value LIMIT 10000"


@query(_stack_sql("event_type", "events"))
def stack_event_type(spark, d):
    return A.stack_values(read(spark, d, "events"), "event_type")


@query(_stack_sql("p_brand", "part"))
def stack_part_brand(spark, d):
    return A.stack_values(read(spark, d, "part"), "p_brand")


@query("SELECT coalesce(p_type, '') AS value, count(*) AS n FROM part WHERE contains(lower(p_type), 'a') GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def unique_values(spark, d):
    return A.unique_values(read(spark, d, "part"), "p_type", "a")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_drilldown(spark, d):
    return A.group_levels(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS non_empty, (count(*) FILTER (WHERE o_totalprice IS NOT NULL))::DOUBLE / count(*)::DOUBLE AS fill_rate,
count(DISTINCT o_totalprice) AS distinct_values, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, round(avg(o_totalprice), 6) AS mean_value FROM orders""")
def column_stats_price(spark, d):
    return A.column_stats(read(spark, d, "orders"), "o_totalprice").withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT unnest(['empty_text', 'empty_number']) AS \"column\"")
def empty_columns(spark, d):
    return A.empty_columns(read(spark, d, "orders").withColumns({"empty_text": F.lit(" "), "empty_number": F.lit(None).cast("int")}))


@query("SELECT text AS value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 100")
def find_duplicates(spark, d):
    return A.duplicates(read(spark, d, "documents"), "text")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")
def only_duplicates(spark, d):
    return A.only_duplicates(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id")


@query("""WITH c AS (SELECT event_type AS source, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1)
SELECT source, first_ts, last_ts, n, (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6 AS span_seconds, (epoch_us(max(last_ts) OVER ()) - epoch_us(min(first_ts) OVER ())) / 1e6 AS total_seconds FROM c""")
def coverage_by_source(spark, d):
    return A.source_coverage(read(spark, d, "events"), "event_type", "ts")


@query("""WITH g AS (SELECT a.d::INTEGER AS dow, h.h::INTEGER AS hour FROM range(1, 8) a(d), range(0, 24) h(h)), c AS (SELECT dayofweek(ts) + 1 AS dow, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT g.dow, g.hour, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.dow = c.dow AND g.hour = c.hour""")
def heatmap_dow_hour(spark, d):
    return A.activity_heatmap(read(spark, d, "events"), "ts")


@query("SELECT c_nationkey, o_orderpriority, count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def edges(spark, d):
    joined = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.edges(joined, "c_nationkey", "o_orderpriority", "o_orderdate")


# Filters, search, sorting.


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'token')")
def search_like(spark, d):
    return read(spark, d, "documents").where(search(["text"], "token", "like")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)[0-9]{1,3}(\.[0-9]{1,3}){3}')")
def search_regex(spark, d):
    return read(spark, d, "documents").where(search(["text"], r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "regex")).select("doc_id")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'token') AND len(list_filter({_TOKENS}, lambda t: starts_with(t, 'exa'))) > 0")
def search_fts(spark, d):
    return read(spark, d, "documents").where(search(["text"], "token exa*", "fts")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' apache license ')")
def search_phrase(spark, d):
    return read(spark, d, "documents").where(search(["text"], '"Apache License"', "fts")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'idiot') OR contains(lower(text), 'idiot')")
def search_mixed(spark, d):
    return read(spark, d, "documents").where(search(["text"], "idiot", "mixed")).select("doc_id")


@query(r"""WITH p AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS tokens FROM part),
g AS (SELECT p_partkey, unnest(tokens) AS t FROM p),
b AS (SELECT p_partkey, CASE WHEN length(t) < 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) END AS x FROM g),
q AS (SELECT list_distinct(list_transform(range(1, length('gizmos')), lambda i: substring('gizmos', i, 2))) AS y)
SELECT DISTINCT p_partkey FROM b, q WHERE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.6""")
def search_fuzzy(spark, d):
    return read(spark, d, "part").where(search(["p_name"], "gizmos", "fuzzy")).select("p_partkey")


@query("SELECT 'documents' AS timeline, count(*) AS hits FROM documents WHERE contains(lower(concat_ws(chr(1), text, lang, source)), 'the') UNION ALL SELECT 'part', count(*) FROM part WHERE contains(lower(concat_ws(chr(1), p_name, p_brand, p_type)), 'the')")
def cross_find(spark, d):
    return search_counts({"documents": read(spark, d, "documents"), "part": read(spark, d, "part")}, "the")


@query("SELECT o_orderkey FROM orders WHERE ((o_totalprice > 100000 OR contains(lower(o_orderpriority), 'urgent')) AND lower(o_orderstatus) <> 'f')")
def filter_advanced(spark, d):
    rules = [Condition("o_totalprice", "greater than", 100000), Condition("o_orderpriority", "contains", "URGENT", "OR"), Condition("o_orderstatus", "not equals", "F")]
    return read(spark, d, "orders").where(advanced(rules)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND contains(lower(props), 'k')")
def filter_layers(spark, d):
    import datetime

    spec = QuerySpec(text={"props": "K"}, checked={"event_type": ["error", "signup"]}, ranges={"ts": (F.lit(datetime.datetime(2024, 1, 5)).cast("timestamp_ntz"), F.lit(datetime.datetime(2024, 1, 20)).cast("timestamp_ntz"))})
    return spec.apply(read(spark, d, "events")).select("event_id")


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 90 MINUTE AND TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 90 MINUTE")
def pivot_minutes(spark, d):
    return pivot_window(read(spark, d, "events"), "ts", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"), 90).select("event_id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500 OFFSET 100")
def sort_page_ts(spark, d):
    return Q.page(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate"), "o_orderkey", True, 100, 500)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice NULLS FIRST, p_partkey LIMIT 200")
def sort_page_numeric(spark, d):
    return Q.page(read(spark, d, "part").select("p_partkey", "p_retailprice"), Q.typed_sort_key("p_retailprice", "numeric"), "p_partkey", limit=200)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) NULLS FIRST, p_partkey LIMIT 200")
def sort_page_text(spark, d):
    return Q.page(read(spark, d, "part").select("p_partkey", "p_name"), Q.typed_sort_key("p_name", "text"), "p_partkey", limit=200)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'red' WHEN contains(lower(props), '1') THEN 'blue' WHEN starts_with(event_type, 'p') THEN 'green' END AS color FROM events")
def color_rules(spark, d):
    rules = [Q.ColorRule("event_type", "equals", "error", "red"), Q.ColorRule("props", "contains", "1", "blue"), Q.ColorRule("event_type", "starts with", "p", "green")]
    events = read(spark, d, "events")
    return events.select("event_id", Q.color_column(events, rules).alias("color"))


@query("SELECT value, ['red', 'green', 'blue'][1 + (row_number() OVER (ORDER BY value) - 1) % 3] AS color FROM (SELECT DISTINCT p_brand AS value FROM part)")
def auto_palette(spark, d):
    return Q.palette(read(spark, d, "part"), "p_brand", ["red", "green", "blue"])


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS _rowid, event_id FROM events")
def row_identity(spark, d):
    return Q.with_row_ids(read(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select(F.col("_rowid"), "event_id")


@query("SELECT event_id FROM events WHERE event_id IN (SELECT user_id FROM events)")
def rows_by_ids(spark, d):
    events = read(spark, d, "events")
    return Q.rows_by_ids(events.select("event_id"), events.select(F.col("user_id").alias("event_id")), "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT user_id FROM events)")
def invert_selection(spark, d):
    events = read(spark, d, "events")
    return Q.invert_selection(events.select("event_id"), events.select(F.col("user_id").alias("event_id")), "event_id")


# Annotations and merging.


@query(f"""WITH {_MINUTES}, c AS (SELECT *, CASE WHEN epoch(minute) - epoch(lag(minute) OVER (ORDER BY minute)) > 720 THEN 1 ELSE 0 END AS cut FROM m),
s AS (SELECT sum(cut) OVER (ORDER BY minute) + 1 AS session, minute FROM c), r AS (SELECT session, min(minute) AS a, max(minute) + INTERVAL 1 MINUTE AS b FROM s GROUP BY 1)
SELECT event_id, 'Session ' || session::BIGINT AS tag FROM events JOIN r ON ts BETWEEN a AND b""")
def bulk_tag_ranges(spark, d):
    events = read(spark, d, "events")
    ranges = temporal.sessions(events, "ts", 12).select("from_ts", (F.col("to_ts") + F.expr("INTERVAL 1 MINUTE")).alias("to_ts"), F.concat(F.lit("Session "), F.col("session").cast("string")).alias("tag"))
    return temporal.tag_ranges(events, "ts", ranges, "event_id")


def _tags(spark, d):
    events = read(spark, d, "events")
    a = annotate.tag_filtered(events, F.col("event_type") == "error", "Failure", "event_id")
    b = annotate.tag_filtered(events, F.col("value") > 50, "Large", "event_id")
    return annotate.add_tags(annotate.add_tags(a, b), a)


@query("SELECT 'Failure' AS tag, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'Large', count(*) FROM events WHERE value > 50")
def tag_summary(spark, d):
    return annotate.tag_summary(_tags(spark, d))


@query("SELECT event_id, concat_ws('|', CASE WHEN event_type = 'error' THEN 'Failure' END, CASE WHEN value > 50 THEN 'Large' END) AS tags FROM events")
def tags_of_rows(spark, d):
    tagged = annotate.with_tags(read(spark, d, "events"), _tags(spark, d), "event_id")
    return tagged.select("event_id", F.array_join("__tags__", "|").alias("tags"))


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 50")
def tag_filter(spark, d):
    return annotate.having_tag(read(spark, d, "events").select("event_id"), _tags(spark, d), ["Failure", "Large"], "event_id")


@query("SELECT event_id AS rowid FROM events WHERE (event_type = 'error') <> (event_id % 2 = 0)")
def bookmark_toggle(spark, d):
    events = read(spark, d, "events")
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("rowid"))
    return annotate.toggle_bookmarks(errors, events.where("event_id % 2 = 0").select(F.col("event_id").alias("rowid")))


@query("""SELECT 'events' AS "_Source", ts AS datetime, event_id AS id, event_type AS kind, '' AS status FROM events UNION ALL
SELECT 'orders', o_orderdate, o_orderkey, '', o_orderstatus FROM orders UNION ALL SELECT 'lineitem', l_shipdate, l_orderkey, '', l_linestatus FROM lineitem""")
def merge_timelines(spark, d):
    events = read(spark, d, "events").select(F.col("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    orders = read(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    lines = read(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"))
    return annotate.merge_timelines({"events": (events, "ts"), "orders": (orders, "ts"), "lineitem": (lines, "ts")}).select("_Source", "datetime", "id", "kind", "status")


from . import detections, files, indexed, movement, profiles, scaled  # noqa: E402, F401  register the rule-based queries and those of readers and sinks
