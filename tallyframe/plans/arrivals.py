"""Looks at files, made of orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.registry import query, table
from tallyframe.streaming import arrivals

BEFORE = "SELECT o_orderkey::VARCHAR AS path, o_custkey AS size, o_orderkey % 97 AS modified FROM orders WHERE o_orderkey % 4 <> 0"
NOW = "SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 6 = 1 THEN o_custkey + 1 WHEN o_orderkey % 6 = 2 THEN 0 ELSE o_custkey END AS size, o_orderkey % 97 AS modified FROM orders WHERE o_orderkey % 5 <> 0"
LEDGER = "SELECT o_orderkey::VARCHAR AS path, o_custkey AS size, o_orderkey % 97 - (o_orderkey % 9 = 0)::INT AS modified, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'failed' END AS outcome, 1 AS at FROM orders WHERE o_orderkey % 3 = 0"


def looks(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.cast("string").alias("path"), F.col("o_custkey").alias("size"), (k % 97).alias("modified"), k)
    before = o.filter(k % 4 != 0).drop("o_orderkey")
    now = o.filter(k % 5 != 0).select("path", F.when(k % 6 == 1, F.col("size") + 1).when(k % 6 == 2, 0).otherwise(F.col("size")).alias("size"), "modified")
    ledger = o.filter(k % 3 == 0).select("path", "size", (F.col("modified") - (k % 9 == 0).cast("int")).alias("modified"), F.when(k % 2 == 0, "done").otherwise("failed").alias("outcome"), F.lit(1).alias("at"))
    return before, now, ledger


@query("settled_files", f"SELECT n.path, n.size, n.modified, coalesce(n.size = b.size AND n.modified = b.modified AND n.size > 0, false) AS settled FROM ({NOW}) n LEFT JOIN ({BEFORE}) b USING (path)".replace("USING (path)", "ON n.path = b.path"))
def settled_files(spark, d):
    before, now, _ = looks(spark, d)
    return arrivals.settled(before, now)


@query(
    "process_once",
    f"""SELECT n.path, n.size, n.modified, CASE WHEN l.outcome IS NOT NULL THEN 'already ' || l.outcome WHEN NOT coalesce(n.size = b.size AND n.modified = b.modified AND n.size > 0, false) THEN 'arriving' ELSE 'do' END AS verdict
        FROM ({NOW}) n LEFT JOIN ({BEFORE}) b ON n.path = b.path LEFT JOIN ({LEDGER.replace("1 AS at", "1 AS a")}) l ON n.path = l.path AND n.size = l.size AND n.modified = l.modified""",
)
def process_once(spark, d):
    return arrivals.decided(*looks(spark, d))


@query("repeat_warnings", """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS seen_at FROM events""")
def repeat_warnings(spark, d):
    log = table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("/", "user_id", "event_type", "props"), 256).alias("fingerprint"))
    return arrivals.repeats(log, "fingerprint", "event_id").select("event_id", "seen_at")


@query("ledger_keys", """SELECT page_id, sha256(url)[1:16] AS key FROM pages""")
def ledger_keys(spark, d):
    return table(spark, d, "pages").select("page_id", F.left(F.sha2("url", 256), F.lit(16)).alias("key"))
