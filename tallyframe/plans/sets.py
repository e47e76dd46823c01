"""Joins, set operations and duplicates over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import greedy, sets
from tallyframe.operators.tables import written
from tallyframe.plans.registry import query, table
from tallyframe.plans.support import kept_one_by_one

#: Two states of the orders: some gone, some repriced, some moved in time, some of another priority.
NOW = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN o_orderstatus || '!' ELSE o_orderstatus END AS words, CASE WHEN o_orderkey % 11 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS place,
                CASE WHEN o_orderkey % 13 = 3 THEN 'x' ELSE o_orderpriority END AS style FROM orders WHERE o_orderkey % 17 <> 4"""
BEFORE = "SELECT o_orderkey, o_orderstatus AS words, o_totalprice AS place, o_orderpriority AS style FROM orders WHERE o_orderkey % 19 <> 5"


def now(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").filter(k % 17 != 4).select(
        "o_orderkey",
        F.when(k % 7 == 1, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")).alias("words"),
        F.when(k % 11 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("place"),
        F.when(k % 13 == 3, "x").otherwise(F.col("o_orderpriority")).alias("style"),
    )


def before(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderkey") % 19 != 5).select("o_orderkey", F.col("o_orderstatus").alias("words"), F.col("o_totalprice").alias("place"), F.col("o_orderpriority").alias("style"))


@query("duplicate_groups", """SELECT min(doc_id) AS first, count(*) AS n, list_sort(list(doc_id)) AS numbers FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return sets.duplicate_groups(table(spark, d, "documents"), ["text"], "doc_id")


@query("duplicate_members", """SELECT doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY text) QUALIFY n > 1""")
def duplicate_members(spark, d):
    return sets.duplicate_members(table(spark, d, "documents"), ["text"], "doc_id")


@query(
    "duplicate_summary",
    """WITH g AS (SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
       SELECT count(*) AS groups, sum(n - 1)::BIGINT AS extra, (SELECT string_agg(first::VARCHAR, ', ' ORDER BY first) FROM (SELECT first FROM g ORDER BY first LIMIT 5)) AS shown, greatest(count(*) - 5, 0) AS more FROM g""",
)
def duplicate_summary(spark, d):
    groups = sets.duplicate_counts(table(spark, d, "documents"), ["text"], "doc_id")
    shown = groups.orderBy("first").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x.cast("string")), ", ").alias("shown"))
    totals = groups.agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"))
    return totals.crossJoin(shown).select("groups", "extra", "shown", F.greatest(F.col("groups") - 5, F.lit(0)).alias("more"))  # one row each


@query("first_earlier_duplicate", """SELECT doc_id, CASE WHEN doc_id > f THEN f END AS same_as FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)""")
def first_earlier_duplicate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return sets.first_earlier(docs, "key", "doc_id").select("doc_id", "same_as")


@query("added_since", f"""WITH n AS ({NOW}), b AS ({BEFORE}) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = n.o_orderkey AND b.words = n.words AND b.place = n.place AND b.style = n.style)""")
def added_since(spark, d):
    return sets.added_since(now(spark, d), before(spark, d))


@query(
    "two_way_difference",
    f"""WITH n AS ({NOW}), b AS ({BEFORE}) SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM n)""",
)
def two_way_difference(spark, d):
    return sets.two_way(now(spark, d), before(spark, d))


@query(
    "classify_changes",
    f"""WITH n AS ({NOW}), b AS ({BEFORE}) SELECT * FROM (SELECT b.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'deleted' WHEN b.words <> n.words THEN 'reworded' WHEN abs(b.place - n.place) > 1e-9 THEN 'moved' WHEN b.style <> n.style THEN 'restyled' END AS change
        FROM b LEFT JOIN n USING (o_orderkey)) WHERE change IS NOT NULL""",
)
def classify_changes(spark, d):
    return sets.classify_changes(before(spark, d), now(spark, d), "o_orderkey", ["words"], ["place"], ["style"])


@query(
    "latest_match",
    """WITH l AS (SELECT user_id, max(event_id) AS last_event_id, arg_max(event_type, event_id) AS last_event_type FROM events WHERE event_type <> 'view' GROUP BY 1)
       SELECT c_custkey AS user_id, last_event_id IS NOT NULL AS known, last_event_id, last_event_type FROM customer LEFT JOIN l ON c_custkey = user_id""",
)
def latest_match(spark, d):
    log = table(spark, d, "events").filter("event_type <> 'view'")
    return sets.latest_match(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), log, "user_id", "event_id", ["event_id", "event_type"])


@query(
    "tolerant_difference",
    """WITH a AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS "at" FROM events WHERE event_type = 'click'), b AS (SELECT user_id, floor(epoch(ts))::BIGINT AS "at" FROM events WHERE event_type = 'view')
       SELECT event_id, user_id, "at" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND abs(a."at" - b."at") <= 86400)""",
)
def tolerant_difference(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), "event_type")
    return sets.tolerant_anti(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), ["user_id"], "at", 86_400)


GRID = "SELECT l_suppkey % 8 AS page, (l_orderkey * 7 % 300)::BIGINT AS x, (l_partkey * 13 % 200)::BIGINT AS y FROM lineitem WHERE l_returnflag = '{}'"


def grid(spark, d, flag):
    return table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 8).alias("page"), (F.col("l_orderkey") * 7 % 300).alias("x"), (F.col("l_partkey") * 13 % 200).alias("y"))


@query(
    "grid_difference",
    f"""WITH a AS (SELECT DISTINCT * FROM ({GRID.format("R")})), b AS (SELECT DISTINCT * FROM ({GRID.format("A")}) WHERE x % 3 = 0)
        SELECT page, x, y FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2)""",
)
def grid_difference(spark, d):
    return sets.grid_anti(grid(spark, d, "R").distinct(), grid(spark, d, "A").filter("x % 3 = 0"), "page", 2)


@query(
    "merge_config",
    """WITH m AS (SELECT n_name AS name, n_regionkey AS value FROM nation WHERE n_nationkey % 3 <> 0), t AS (SELECT n_name AS name, n_regionkey + (n_nationkey % 2)::INT AS value FROM nation WHERE n_nationkey % 4 <> 0)
       SELECT coalesce(m.name, t.name) AS name, CASE WHEN m.name IS NULL THEN t.value WHEN t.name IS NOT NULL AND m.value <> t.value THEN t.value ELSE m.value END::INT AS value,
              CASE WHEN m.name IS NULL THEN 'added' WHEN t.name IS NOT NULL AND m.value <> t.value THEN 'replaced' ELSE 'same' END AS outcome FROM m FULL JOIN t ON m.name = t.name""",
)
def merge_config(spark, d):
    n = table(spark, d, "nation")
    mine = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    theirs = n.filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).cast("int").alias("value"))
    return sets.merge_config(mine, theirs, "name", "value", replace=True)


ASKED_FOR = "CASE c_custkey % 6 WHEN 0 THEN 'Acme ' || s WHEN 1 THEN lower(replace(s, '#', ' - ')) WHEN 2 THEN ' SUP_' || n || ' ' WHEN 3 THEN 'acme-S.' || n WHEN 4 THEN 'Sold as ' || n ELSE 'S.' || n || 'x' END"


@query(
    "alias_lookup",
    f"""WITH RECURSIVE k AS (SELECT s_suppkey, s_name, ['SUP-' || s_suppkey, 'S.' || s_suppkey, 'S.' || (s_suppkey + 1)] AS also FROM supplier),
            n AS (SELECT s_suppkey, unnest([s_name] || also) AS name FROM k),
            t AS (SELECT s_suppkey, regexp_replace(regexp_replace(lower(trim(name)), '[ _-]', '', 'g'), '^acme', '') AS key FROM n),
            f AS (SELECT key, min(s_suppkey) AS s_suppkey FROM t GROUP BY key),
            a AS (SELECT c_custkey, {ASKED_FOR} AS asked FROM (SELECT c_custkey, c_custkey % 40 + 1 AS n, 'Supplier#' || lpad((c_custkey % 40 + 1)::VARCHAR, 9, '0') AS s FROM customer))
       SELECT c_custkey, asked, f.s_suppkey FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(asked)), '[ _-]', '', 'g'), '^acme', '') AS key FROM a) a LEFT JOIN f USING (key)""",
)
def alias_lookup(spark, d):
    """Stock by its code or any other code that it is sold under; `S.5` is a code of two, and the first in the list has it."""
    k = F.col("s_suppkey")
    stock = table(spark, d, "supplier").select(k, F.col("s_name").alias("code"), F.array(F.concat(F.lit("SUP-"), k), F.concat(F.lit("S."), k), F.concat(F.lit("S."), k + 1)).alias("also"))
    n = F.col("c_custkey") % 40 + 1
    s, m = F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0")), F.col("c_custkey") % 6
    asked = F.when(m == 0, F.concat(F.lit("Acme "), s)).when(m == 1, F.lower(F.replace(s, F.lit("#"), F.lit(" - ")))).when(m == 2, F.concat(F.lit(" SUP_"), n, F.lit(" ")))
    asked = asked.when(m == 3, F.concat(F.lit("acme-S."), n)).when(m == 4, F.concat(F.lit("Sold as "), n)).otherwise(F.concat(F.lit("S."), n, F.lit("x")))
    return sets.by_code(table(spark, d, "customer").select("c_custkey", asked.alias("asked")), "asked", stock, "code", "also", "s_suppkey", maker="acme")


@query(
    "exact_then_contains",
    """WITH n AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^\\pL\\pN]', '', 'g')) AS key FROM part),
            w AS (SELECT c_custkey, wanted, lower(regexp_replace(wanted, '[^\\pL\\pN]', '', 'g')) AS key
                  FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 3, 7) WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN p_name || ' x' ELSE ' ' || substr(p_name, 2, 2) END AS wanted
                        FROM customer JOIN part ON p_partkey = c_custkey))
       SELECT c_custkey, wanted, coalesce(min(p_partkey) FILTER (n.key = w.key), min(p_partkey)) AS p_partkey
       FROM w LEFT JOIN n ON w.key <> '' AND contains(n.key, w.key) GROUP BY c_custkey, wanted""",
)
def exact_then_contains(spark, d):
    part, k = table(spark, d, "part"), F.col("c_custkey") % 5
    name = F.col("p_name")
    wanted = F.when(k == 0, F.upper(name)).when(k == 1, F.substring(name, 3, 7)).when(k == 2, F.replace(name, F.lit(" "), F.lit("-"))).when(k == 3, F.concat(name, F.lit(" x"))).otherwise(F.concat(F.lit(" "), F.substring(name, 2, 2)))
    asked = table(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey")).select("c_custkey", wanted.alias("wanted"))
    found = sets.by_name(asked.select("wanted"), "wanted", part.select("p_name", "p_partkey"), "p_name", "p_partkey")
    return asked.join(found, "wanted", "left").select("c_custkey", "wanted", "p_partkey")


@query(
    "every_architecture",
    """WITH p AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'all' ELSE p_brand END AS arch FROM part)
       SELECT a.arch AS target, p_partkey FROM (SELECT DISTINCT arch FROM p) a JOIN p ON p.arch = a.arch OR (p.arch = 'all' AND a.arch <> 'all')""",
)
def every_architecture(spark, d):
    arch = F.when(F.col("p_size") % 9 == 0, "all").otherwise(F.col("p_brand"))
    return sets.for_every(table(spark, d, "part").select("p_partkey", arch.alias("arch")), "arch", "all").select("target", "p_partkey")


@query(
    "assembled_records",
    """SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS signup, arg_min(value, event_id) FILTER (event_type = 'purchase') AS first_value, max(event_id) FILTER (event_type = 'error') AS last_error
       FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'signup') > 0""",
)
def assembled_records(spark, d):
    kind = lambda t, c: F.when(F.col("event_type") == t, F.col(c))
    e = table(spark, d, "events").groupBy("user_id").agg(F.min(kind("signup", "event_id")).alias("signup"), F.min_by(kind("purchase", "value"), kind("purchase", "event_id")).alias("first_value"), F.max(kind("error", "event_id")).alias("last_error"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return e.filter("p > 0 AND signup IS NOT NULL").drop("p")


@query(
    "merged_entities",
    """WITH r AS (SELECT s_nationkey AS key0, s_suppkey % 5 AS key1, s_suppkey AS o, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal END AS bal, 2 * (s_suppkey % 2) + (s_suppkey % 3 = 0)::INT AS w FROM supplier)
       SELECT key0, key1, coalesce(arg_max_null(name, w * 1000000 - o), arg_min(name, o) FILTER (name IS NOT NULL)) AS name, coalesce(arg_max_null(bal, w * 1000000 - o), arg_min(bal, o) FILTER (bal IS NOT NULL)) AS bal, count(*) AS seen FROM r GROUP BY key0, key1""",
)
def merged_entities(spark, d):
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k, "s_nationkey", F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.when(k % 2 != 0, F.col("s_acctbal")).alias("bal"))
    return sets.merge_entities(r, [F.col("s_nationkey"), k % 5], 2 * (k % 2) + (k % 3 == 0).cast("int"), "s_suppkey", ["name", "bal"])


@query(
    "inherited_styles",
    """WITH RECURSIVE s AS (SELECT p_partkey, p_partkey // 10 AS parent, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS style FROM part),
            up AS (SELECT p_partkey, parent, style FROM s UNION ALL SELECT up.p_partkey, s.parent, s.style FROM up JOIN s ON s.p_partkey = up.parent WHERE up.style IS NULL AND up.parent <> up.p_partkey)
       SELECT p_partkey, any_value(style) FILTER (style IS NOT NULL) AS style FROM up GROUP BY 1""",
)
def inherited_styles(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("parent"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("style"))
    up = s.select(F.col("p_partkey").alias("at"), F.col("parent").alias("next"), F.col("style").alias("given"))
    done, open_ = s.filter("style IS NOT NULL"), s.filter("style IS NULL")
    for _ in range(15):  # a style and its ancestors are 16 levels at most
        found = open_.join(up, open_["parent"] == up["at"], "left")
        found = written(found.select("p_partkey", F.when(F.col("at").isNotNull() & (F.col("next") != F.col("at")), F.col("next")).alias("parent"), F.col("given").alias("style")), "styles")
        # Who has a style or no further ancestor is done.
        done = done.unionAll(found.filter("style IS NOT NULL OR parent IS NULL"))
        open_ = found.filter("style IS NULL AND parent IS NOT NULL")
        if open_.isEmpty():
            break
    out = done.unionAll(open_)
    return out.select("p_partkey", "style")


@query(
    "phrases_found",
    """WITH w AS (SELECT doc_id, text FROM documents) SELECT b.item_id, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN w d ON contains(d.text, b.text) GROUP BY b.item_id""",
)
def phrases_found(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = sets.containing(docs, "doc_id", "text", items, "item_id", "text")
    counts = hits.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("union_of_parts", """SELECT n_nationkey AS key, n_name AS name, 1 AS part FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region""")
def union_of_parts(spark, d):
    return sets.concatenated([table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))])


@query(
    "page_verdicts",
    """SELECT o_orderkey, CASE WHEN r > 0 AND a > 0 THEN 'reprint' WHEN a > 0 THEN 'feed' ELSE 'nothing' END AS verdict FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""",
)
def page_verdicts(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return pages.select("o_orderkey", F.when((F.col("r") > 0) & (F.col("a") > 0), "reprint").when(F.col("a") > 0, "feed").otherwise("nothing").alias("verdict"))


@query("shared_targets", """SELECT lower(p_name) AS target, list_sort(list(DISTINCT p_brand)) AS sources FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def shared_targets(spark, d):
    return sets.shared_targets(table(spark, d, "part"), "p_name", "p_brand")


@query("conflicting_contents", """SELECT p_name, count(DISTINCT sha256(p_type || p_size)) AS contents FROM part GROUP BY 1 HAVING count(DISTINCT sha256(p_type || p_size)) > 1""")
def conflicting_contents(spark, d):
    return sets.conflicts(table(spark, d, "part").withColumn("h", F.sha2(F.concat("p_type", "p_size"), 256)), "p_name", "h")


@query(
    "tolerance_distinct",
    kept_one_by_one("SELECT p_brand AS g, p_partkey AS o, p_size * 1.0::DOUBLE AS x, p_retailprice / 100 AS y FROM part", "abs(k.x - m.x) <= 0.5 AND abs(k.y - m.y) <= 0.5") + " SELECT g AS p_brand, k.o AS p_partkey, k.x AS x, k.y AS y FROM e",
)
def tolerance_distinct(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return greedy.distinct_shapes(p, "p_brand", "p_partkey", ["x", "y"], 0.5)


@query("undo_ring", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10""")
def undo_ring(spark, d):
    return sets.newest(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 10)
