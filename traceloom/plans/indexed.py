"""Queries of structures that are built once and read often: the full-text index, sorted pages, profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext, sorted_table
from .registry import query, read
from .scaled import _PADDED, _both


@query("SELECT doc_id FROM (SELECT doc_id, " + _PADDED.format("text") + " AS t FROM documents) WHERE contains(t, ' apache license ') AND contains(t, ' the ')")
def index_phrase_and_word(spark, d):
    """A phrase and a frequent word, from the postings of three words."""
    docs = read(spark, d, "documents")
    return fulltext.build_index(docs, ["text", "source"], "doc_id").search(docs, 'the "Apache License"', "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])tok') OR regexp_matches(lower(source), '(^|[^\\p{L}\\p{N}])tok')")
def index_prefix(spark, d):
    docs = read(spark, d, "documents")
    return fulltext.build_index(docs, ["text", "source"], "doc_id").search(docs, "tok*", "doc_id").select("doc_id")


@query(f"SELECT p_partkey FROM part WHERE {_both('widget')} AND {_both('standard')}")
def index_columns(spark, d):
    """Terms that stand in different columns."""
    part = read(spark, d, "part")
    return fulltext.build_index(part, ["p_name", "p_type"], "p_partkey").search(part, "widget standard", "p_partkey").select("p_partkey")


@query("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS rows FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS token FROM documents) GROUP BY 1")
def index_words(spark, d):
    """What the index holds: every word with its places and its rows."""
    index = fulltext.build_index(read(spark, d, "documents"), ["text"], "doc_id")
    return index.table.rows().groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("rows"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 500 OFFSET 1500")
def keyset_page(spark, d):
    """The fourth page by keys: each is read after the last row of the one before."""
    table, last = sorted_table.write_sorted(read(spark, d, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"]), None
    for _ in range(3):
        last = tuple(table.page(last, 500).orderBy(*[F.desc(k) for k in table.keys]).select(*table.keys).first())
    return table.page(last, 500).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, ts FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS ts FROM events) ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 300 OFFSET 300")
def keyset_page_descending(spark, d):
    """The second page from the end, of a column with nulls, which come last then."""
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("ts"))
    table = sorted_table.write_sorted(rows, ["ts", "event_id"])
    last = table.page(None, 300, descending=True).orderBy("ts", "event_id").select("ts", "event_id").first()
    return table.page(tuple(last), 300, descending=True)
