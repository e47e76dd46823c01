"""Forms made of customers, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.template import field_spec
from tallyframe.operators import extract
from tallyframe.plans.registry import query, table

FORM = """SELECT c_custkey, 'Name: ' || c_name || ' Segment: ' || c_mktsegment || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN 'Balance' WHEN c_custkey % 7 = 0 THEN 'Balance 1 Balance 2' ELSE 'Balance' END || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_acctbal::BIGINT || ' EUR' END AS form FROM customer"""


def forms(spark, d):
    k = F.col("c_custkey")
    head = F.concat(F.lit("Name: "), "c_name", F.lit(" Segment: "), "c_mktsegment")
    label = F.when(k % 5 == 0, "Balance").when(k % 7 == 0, "Balance 1 Balance 2").otherwise("Balance")
    value = F.when(k % 5 == 0, "").otherwise(F.concat(F.format_string("%d", F.rint("c_acctbal").cast("long")), F.lit(" EUR")))
    return table(spark, d, "customer").select(k, F.concat_ws("\n", head, label, value).alias("form"))


FIELDS = ["Name", "Segment", "Balance/below/number", "Missing"]


@query(
    "pick_fields",
    """WITH k AS (SELECT *, c_custkey % 5 = 0 AS blank, c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AS twice FROM customer)
       SELECT c_custkey AS sheet, 'Name' AS field, 'Read' AS status, c_name AS text, NULL::BIGINT AS n FROM k
       UNION ALL SELECT c_custkey, 'Segment', 'Read', c_mktsegment, NULL FROM k
       UNION ALL SELECT c_custkey, 'Missing', 'NoLabel', NULL, NULL FROM k
       UNION ALL SELECT c_custkey, 'Balance', CASE WHEN twice THEN 'Twice' WHEN blank THEN 'Blank' ELSE 'Read' END, CASE WHEN NOT twice AND NOT blank THEN round_even(c_acctbal, 0)::BIGINT || ' EUR' END, CASE WHEN twice THEN 2 END FROM k""",
)
def pick_fields(spark, d):
    words = extract.placed_words(forms(spark, d), "c_custkey", "form")
    return extract.pick_fields(words, [field_spec(f) for f in FIELDS])


@query(
    "resolve_anchor",
    """SELECT c_custkey AS sheet, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Found' ELSE 'NotFound' END AS status, (c_mktsegment = 'BUILDING')::BIGINT AS n FROM customer""",
)
def resolve_anchor(spark, d):
    words = extract.placed_words(forms(spark, d), "c_custkey", "form")
    return extract.resolve_anchor(words, "building").select("sheet", "status", "n")


@query(
    "long_phrases",
    """SELECT doc_id AS sheet, min(i - 1)::INT AS line, count(*) AS hits FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM (
         SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'x It was — the best of times, it was the worst of times! y' WHEN 1 THEN chr(10) || 'i t w a s t h e b e s t o f t i m e s it was the worst of times' WHEN 2 THEN chr(10) || 'it was the best of times, it was the worst of' ELSE '' END AS t FROM documents)))
       WHERE contains(lower(regexp_replace(l, '[^\\pL\\pN]', '', 'g')), 'itwasthebestoftimesitwastheworstoftimes') GROUP BY doc_id""",
)
def long_phrases(spark, d):
    """A phrase of twelve words, also with marks between and spelled out."""
    k = F.col("doc_id") % 4
    more = F.when(k == 0, "\nx It was — the best of times, it was the worst of times! y").when(k == 1, "\ni t w a s t h e b e s t o f t i m e s it was the worst of times").when(k == 2, "\nit was the best of times, it was the worst of").otherwise("")
    words = extract.placed_words(table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("t")), "doc_id", "t")
    return extract.phrase_hits(words, "It was the best of times, it was the worst of times", 0).groupBy("sheet").agg(F.min("line").alias("line"), F.count("*").alias("hits"))


@query("phrase_hits", """SELECT c_custkey AS sheet, 0 AS line, 2 + len(string_split(c_name, ' ')) - 1 AS first FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""".replace("WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "WHERE c_mktsegment = 'MACHINERY'"))
def phrase_hits(spark, d):
    words = extract.placed_words(forms(spark, d), "c_custkey", "form")
    return extract.phrase_hits(words, "Segment: MACHINERV", 2).select("sheet", "line", F.col("first").cast("long").alias("first"))


@query(
    "corrections",
    """WITH s AS (SELECT c_custkey AS sheet, c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AS twice FROM customer)
       SELECT sheet, CASE WHEN twice THEN 'FoundTwice' ELSE 'Planned' END AS status, CASE WHEN twice THEN 2 ELSE 1 END AS n, CASE WHEN NOT twice THEN -0.6 END::DOUBLE AS cover_x, CASE WHEN NOT twice THEN 4.4 END::DOUBLE AS cover_y,
              CASE WHEN NOT twice THEN 15.2 END::DOUBLE AS cover_w, CASE WHEN NOT twice THEN 4.7 END::DOUBLE AS cover_h, CASE WHEN NOT twice THEN 0 END::DOUBLE AS x, CASE WHEN NOT twice THEN 8.5 END::DOUBLE AS baseline,
              CASE WHEN NOT twice THEN round(5 * 72 / 25.4::DOUBLE, 6) END AS size_pt, CASE WHEN NOT twice THEN 15 * 2.5 - 14 END::DOUBLE AS over FROM s""",
)
def corrections(spark, d):
    got = extract.corrections(extract.placed_words(forms(spark, d), "c_custkey", "form"), "Balance", "Account balance")
    return got.select("sheet", "status", F.col("n").cast("int").alias("n"), *[F.round(c, 6).alias(c) for c in ("cover_x", "cover_y", "cover_w", "cover_h", "x", "baseline", "size_pt", "over")])


@query(
    "suggestions",
    f"""WITH l AS (SELECT c_custkey AS sheet, generate_subscripts(s, 1) - 1 AS line, trim(unnest(s)) AS said FROM (SELECT c_custkey, string_split(form, chr(10)) AS s FROM ({FORM.replace("c_acctbal::BIGINT", "round_even(c_acctbal, 0)::BIGINT")}))),
             r AS (SELECT *, coalesce((SELECT max(n) FROM range(1, 9) a(n), range(1, 9) b(i) WHERE i + n <= 9 AND contains(lower(regexp_replace(said, '[^\\pL\\pN]', '', 'g')), substr('balances', i::INT, n::INT))), 0) AS run FROM l WHERE said <> ''),
             s AS (SELECT *, max(run) OVER (PARTITION BY sheet) >= 3 AS shared FROM r)
        SELECT sheet, line::INT AS line, said, run::INT AS run FROM s WHERE NOT shared OR run >= 3 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY CASE WHEN shared THEN -run ELSE 0 END, line) <= 3""",
)
def suggestions(spark, d):
    return extract.suggestions(extract.placed_words(forms(spark, d), "c_custkey", "form"), "Balances")


@query(
    "flattened_words",
    """SELECT conv_id, turn, u::INT AS word_no, w AS word FROM (SELECT conv_id, turn, unnest(s) AS w, generate_subscripts(s, 1) - 1 AS u FROM (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations))""",
)
def flattened_words(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("word_no", "word"))


@query("first_line_with", """SELECT doc_id, min(u)::INT AS line FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE contains(lower(l), 'license') GROUP BY 1""")
def first_line_with(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.filter(F.contains(F.lower("l"), F.lit("license"))).groupBy("doc_id").agg((F.min("line") + 1).alias("line"))


@query("field_gaps", """SELECT 'Balance' AS field, count(*) FILTER (c_custkey % 5 = 0) AS blank, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 = 0) AS twice, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS read FROM customer""")
def field_gaps(spark, d):
    picked = pick_fields(spark, d).filter("field = 'Balance'")
    return picked.groupBy("field").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Blank", "Twice", "Read")])
