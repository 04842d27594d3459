"""Queries of profiles: known findings by rules kept as a table, many indicators as a table, and profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, annotate, ioc, process
from .registry import query, read

_NEEDLES = r"needles AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{6,}')) AS ioc FROM benchmark)"


@query(f"WITH {_NEEDLES} SELECT ioc, doc_id AS \"row\" FROM needles JOIN documents ON contains(lower(text), ioc)")
def ioc_many(spark, d):
    """Every longer word of the benchmark as an indicator, more of them than an automaton is allowed here."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{6,}"), F.lit(0)))
    needles = read(spark, d, "benchmark").select(words.alias("ioc")).distinct()
    return ioc.match(read(spark, d, "documents"), needles, ["text"], "doc_id", at_once=10)


# Findings: an event each. Rules: one for each user and type of a third of the events, and parts of commands.

_FOUND = "f AS (SELECT event_id, event_type || '.exe' AS process, 'h' || user_id AS host, lower(props) AS command, CAST(event_id % 4 AS INTEGER) AS level FROM events)"
_RULES = "r AS (SELECT DISTINCT event_type || '.exe' AS process, 'h' || user_id AS host FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0), p AS (SELECT DISTINCT 'h' || user_id AS host, ': ' || user_id % 9 AS part FROM events WHERE user_id % 5 = 1)"
_KNOWN = "(EXISTS (SELECT 1 FROM r WHERE r.process = f.process AND r.host = f.host) OR EXISTS (SELECT 1 FROM p WHERE p.host = f.host AND contains(f.command, p.part)) OR contains(f.command, ': 77') OR contains(f.command, '5}'))"


def _findings(spark, d):
    e = read(spark, d, "events")
    image = F.concat(F.lit("C:\\x\\"), "event_type", F.lit(".exe"))
    return e.select("event_id", image.alias("image"), F.lit("").alias("parent_image"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.lit("u").alias("user"), F.col("props").alias("command"), (F.col("event_id") % 4).cast("int").alias("level"))


def _rules(spark, d):
    e, host = read(spark, d, "events"), F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("host")
    none = F.lit(None).cast("string")
    exact = e.where("event_id % 3 = 0 AND user_id % 2 = 0").select(F.concat(F.upper("event_type"), F.lit(".EXE")).alias("process"), host, none.alias("command_contains"))
    part = e.where("user_id % 5 = 1").select(F.lit("").alias("process"), host, F.concat(F.lit(": "), (F.col("user_id") % 9).cast("string")).alias("command_contains"))
    texts = e.limit(1).select(none.alias("process"), none.alias("host"), F.explode(F.array(F.lit(": 77"), F.lit("5}"))).alias("command_contains"))
    return exact.unionByName(part).unionByName(texts).withColumn("reason", F.lit("known"))


@query(f"WITH {_FOUND}, {_RULES} SELECT event_id FROM f WHERE NOT {_KNOWN}")
def profile_rules_many(spark, d):
    """Hundreds of rules of three kinds: exact fields, a field and a part of the command, parts of commands alone."""
    return annotate.suppress(_findings(spark, d), _rules(spark, d)).select("event_id")


@query(f"""WITH {_FOUND}, {_RULES}, k AS (SELECT *, {_KNOWN} AS suppressed, process = 'view.exe' AS expected FROM f), v AS (SELECT 'raw' AS mode, * FROM k UNION ALL SELECT 'hunt', * FROM k WHERE level >= 1 AND NOT suppressed)
SELECT mode, count(*) AS n, count(*) FILTER (WHERE suppressed) AS suppressed, count(*) FILTER (WHERE expected) AS expected FROM v GROUP BY mode
UNION ALL SELECT 'triage', count(*), 0, count(*) FILTER (WHERE process = 'view.exe') FROM (SELECT DISTINCT host, process, command FROM k WHERE level >= 1 AND NOT suppressed)""")
def profile_modes(spark, d):
    """What each view shows of findings that suppressions and baselines have marked."""
    expected = read(spark, d, "events").limit(1).select(F.lit("view.exe").alias("process"), F.lit("usual").alias("reason"))
    rows = annotate.with_profile(_findings(spark, d), _rules(spark, d), expected)
    count = [F.count(F.lit(1)).alias("n"), F.count_if("suppressed").alias("suppressed"), F.count_if("expected").alias("expected")]
    modes = [process.view(rows, m).agg(*count).select(F.lit(m).alias("mode"), "n", "suppressed", "expected") for m in ("raw", "hunt", "triage")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def _profile_sql(column: str, kind: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    number = f"CAST({column} AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
    ends = f"epoch(max({column})) - epoch(min({column}))" if kind == "time" else "NULL"
    top = f"(SELECT string_agg(v || '=' || k, ',' ORDER BY k DESC, v) FROM (SELECT {text} AS v, count(*) AS k FROM orders WHERE {text} <> '' GROUP BY 1 ORDER BY k DESC, v LIMIT 3))" if kind == "text" else "NULL"
    return f"SELECT '{column}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE {text} <> '') AS non_empty, round(avg({number}), 4) AS mean_value, {'true' if kind == 'number' else 'NULL'} AS middle_is_right, CAST({ends} AS DOUBLE) AS span_seconds, {top} AS top FROM orders"


@query(" UNION ALL ".join(_profile_sql(c, k) for c, k in (("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderstatus", "text"), ("o_orderpriority", "text"))))
def column_profile(spark, d):
    """Numbers, times and texts of four columns from one scan; the most frequent values where they are exact; whether the
    bound in the middle has half of the rows below it, within a thousandth."""
    orders = read(spark, d, "orders")
    found = aggregate.column_profile(orders, ["o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    top = F.array_join(F.transform(F.slice("top", 1, 3), lambda x: F.concat_ws("=", x["item"], x["count"].cast("string"))), ",")
    text = F.col("column").isin("o_orderstatus", "o_orderpriority")
    middle = found.where("column = 'o_totalprice'").select(F.get("bounds", F.lit(4)).alias("middle"))
    below = orders.join(F.broadcast(middle), F.col("o_totalprice") <= F.col("middle")).agg(F.count(F.lit(1)).alias("below"))  # one row
    found = found.join(F.broadcast(below), F.col("column") == "o_totalprice", "left")
    right = F.abs(F.col("below") / F.col("n") - 0.5) <= 0.001
    return found.select("column", "n", "non_empty", F.round("mean_value", 4).alias("mean_value"), right.alias("middle_is_right"), "span_seconds", F.when(text & F.col("top_exact"), top).alias("top"))
