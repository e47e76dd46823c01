"""Projections, predicates and scalar functions over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import measure, template, text
from tallyframe.plans.registry import query, table

LABEL = "{c_name} of {c_nationkey}: {number} {unknown} {"


@query(
    "fill_template",
    """SELECT c_custkey, c_name || ' of ' || c_nationkey || ': ' || c_custkey || ' {unknown} {' AS label FROM customer""",
)
def fill_template(spark, d):
    df = table(spark, d, "customer").withColumn("number", F.col("c_custkey"))
    return df.select("c_custkey", template.fill(LABEL, [c for c in df.columns if c != "number"]).alias("label"))


@query(
    "unknown_columns",
    """WITH c AS (SELECT column_name FROM (DESCRIBE customer)),
            n AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all('{c_name} ' || text || ' {' || role || '} {c_nationkey} {date} {number} {' || lower(split_part(text, ' ', 1)) || '}', '[{]([^}]*)[}]', 1))) AS name FROM conversations)
       SELECT name, count(*) AS templates, min(conv_id * 1000 + turn) AS first FROM n WHERE name NOT IN (SELECT column_name FROM c) AND name NOT IN ('date', 'number', '') AND NOT contains(name, '{') GROUP BY name""",
)
def unknown_columns(spark, d):
    """Templates are rows: what they name that the list hasn't got, in how many of them, and in which first."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.concat(F.lit("{c_name} "), "text", F.lit(" {"), "role", F.lit("} {c_nationkey} {date} {number} {"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))), F.lit("}")).alias("t"))
    return template.unknown_in(turns, "t", "at", [*table(spark, d, "customer").columns, "date", "number"])


@query(
    "placeholders",
    """SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(t, '[{]([^}]*)[}]', 1)), lambda x: x <> '' AND NOT contains(x, '{'))) AS names
       FROM (SELECT p_partkey, '{a}' || p_name || '{size} {} {a{b} {size}' AS t FROM part) WHERE true""",
)
def placeholders(spark, d):
    t = F.concat(F.lit("{a}"), "p_name", F.lit("{size} {} {a{b} {size}"))
    return table(spark, d, "part").select("p_partkey", F.array_sort(template.placeholders(t)).alias("names"))


@query(
    "missing_parameters",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['brand'] ELSE ['brand', 'size'] END AS missing FROM part""",
)
def missing_parameters(spark, d):
    t = F.lit("{name} {size} {brand}")
    given = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("name"), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.array_sort(template.missing(t, given)).alias("missing"))


@query(
    "builtin_values",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS today, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y') AS year,
              strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day FROM orders""",
)
def builtin_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in template.builtin(F.col("o_orderdate")).items()])


@query(
    "unit_conversions",
    """SELECT p_partkey, round(p_size * 72.0 / 25.4, 6) AS pt, round(p_size * 25.4 / 72.0, 6) AS mm, round(p_size * 400.0 / 25.4, 6) AS px FROM part""",
)
def unit_conversions(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in (("pt", measure.mm_to_pt(size)), ("mm", measure.pt_to_mm(size)), ("px", measure.mm_to_px(size, 400.0)))])


@query(
    "sheet_sizes",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A4' WHEN 1 THEN ' letter' WHEN 2 THEN (p_size * 10) || 'x' || (p_size + 3) WHEN 3 THEN p_size || '*9000' ELSE p_name END AS spec FROM part)
       SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 210.0 WHEN p_partkey % 5 = 1 THEN 215.9 WHEN p_partkey % 5 = 2 AND p_size >= 2 THEN p_size * 10.0 END::DOUBLE AS width,
              CASE WHEN p_partkey % 5 = 0 THEN 297.0 WHEN p_partkey % 5 = 1 THEN 279.4 WHEN p_partkey % 5 = 2 AND p_size >= 2 THEN p_size + 3.0 END::DOUBLE AS height
       FROM s JOIN part USING (p_partkey)""",
)
def sheet_sizes(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    spec = F.when(k == 0, "A4").when(k == 1, " letter").when(k == 2, F.concat(size * 10, F.lit("x"), size + 3)).when(k == 3, F.concat(size, F.lit("*9000"))).otherwise(F.col("p_name"))
    got = measure.sheet_size(spec)
    return table(spark, d, "part").select("p_partkey", got["width"].alias("width"), got["height"].alias("height"))


@query(
    "near_sizes",
    """SELECT count(*) FILTER (abs(l_quantity - l_discount * 500) <= 3) AS close, count(*) AS n FROM lineitem""",
)
def near_sizes(spark, d):
    return table(spark, d, "lineitem").agg(F.count_if(measure.near(F.col("l_quantity"), F.col("l_discount") * 500, 3.0)).alias("close"), F.count("*").alias("n"))


FILES = """CASE page_id % 7 WHEN 0 THEN '.hidden.pdf' WHEN 1 THEN 'a.pdf.part' WHEN 2 THEN 'noending' WHEN 3 THEN 'x-delta.pdf' WHEN 4 THEN 'b.PNG' WHEN 5 THEN 'c.xyz' ELSE 'd.Pdf' END"""


@query(
    "eligible_files",
    f"""SELECT page_id, CASE {FILES} WHEN '.hidden.pdf' THEN 'hidden' WHEN 'a.pdf.part' THEN 'unfinished' WHEN 'noending' THEN 'no ending' WHEN 'x-delta.pdf' THEN 'own output'
               WHEN 'b.PNG' THEN 'picture' WHEN 'c.xyz' THEN 'unknown kind' ELSE 'eligible' END AS reason FROM pages""",
)
def eligible_files(spark, d):
    from tallyframe.sources.files import why_not

    name = F.element_at(F.array(*[F.lit(x) for x in (".hidden.pdf", "a.pdf.part", "noending", "x-delta.pdf", "b.PNG", "c.xyz", "d.Pdf")]), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.coalesce(why_not(name), F.lit("eligible")).alias("reason"))


NUMBERS = ("1,200", "£ 5.", ".5", "1e3", "1d", "1_0", "nan", "-Inf", "(12)", "twelve", "", "+", "45 %", "0x1", "1.2.3", " 7")


@query(
    "number_shaped",
    f"""WITH t AS (SELECT s_suppkey, [{", ".join("'" + n + "'" for n in NUMBERS)}][(s_suppkey % {len(NUMBERS)} + 1)::INT] AS t FROM supplier)
        SELECT s_suppkey, t AS written, regexp_matches(translate(t, ', ()' || chr(160) || '£$€¥%', ''), '^[+-]?((?i:inf|infinity|nan)|([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)$') AS is_number FROM t""",
)
def number_shaped(spark, d):
    t = F.element_at(F.array(*[F.lit(n) for n in NUMBERS]), (F.col("s_suppkey") % len(NUMBERS) + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", t.alias("written"), text.is_number(t).alias("is_number"))


@query(
    "valid_names",
    """SELECT p_partkey, regexp_full_match(n, '[A-Za-z0-9_-]{1,64}') AS valid FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') ELSE '' END AS n FROM part)""",
)
def valid_names(spark, d):
    k = F.col("p_partkey") % 3
    n = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", text.valid_name(n).alias("valid"))


@query("rows_from", """SELECT o_orderkey, o_orderkey - 100 + 500 AS number FROM orders WHERE o_orderkey >= 100""")
def rows_from(spark, d):
    from tallyframe.operators.sequence import from_row, renumbered

    return renumbered(from_row(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100), "o_orderkey", 500, first=100).select("o_orderkey", "number")


@query(
    "colours",
    """WITH c AS (SELECT p_partkey, md5(p_name)[1:6] AS h FROM part)
       SELECT p_partkey, round(('0x' || h[1:2])::INT / 255.0, 6)::DOUBLE AS r, round(('0x' || h[3:4])::INT / 255.0, 6)::DOUBLE AS g, round(('0x' || h[5:6])::INT / 255.0, 6)::DOUBLE AS b FROM c""",
)
def colours(spark, d):
    c = measure.colour(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)))
    return table(spark, d, "part").select("p_partkey", *[F.round(c[k], 6).alias(k) for k in "rgb"])


@query(
    "padded_boxes",
    """SELECT p_partkey, greatest(p_size - 5.0, 0)::DOUBLE AS x0, least(p_size + 20 + 5.0, 60)::DOUBLE AS x1 FROM part""",
)
def padded_boxes(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.greatest(size - 5, F.lit(0.0)).alias("x0"), F.least(size + 25, F.lit(60.0)).alias("x1"))


@query("counted_source", """SELECT c_custkey, unnest(range(1, n + 1))::BIGINT AS number FROM (SELECT c_custkey, 1 + c_custkey % 12 AS n FROM customer)""")
def counted_source(spark, d):
    """Rows 1 to n for each customer who asks for n of them."""
    from tallyframe.sources.lists import counted_for

    asked = table(spark, d, "customer").select("c_custkey", (1 + F.col("c_custkey") % 12).alias("n"))
    return counted_for(asked, "n").select("c_custkey", "number")


@query(
    "squash",
    """SELECT p_partkey, lower(regexp_replace(p_name, '[^\\pL\\pN]', '', 'g')) AS key, lower(regexp_replace(p_name, '\\s', '', 'g')) AS spaceless,
              translate(lower(regexp_replace(p_name || ' 0158', '[^\\pL\\pN]', '', 'g')), '0i15286', 'ollszbg') AS shape,
              CASE WHEN length(lower(regexp_replace(p_name, '[^\\pL\\pN]', '', 'g'))) < 5 THEN 0 ELSE length(lower(regexp_replace(p_name, '[^\\pL\\pN]', '', 'g'))) // 4 END::INT AS budget FROM part""",
)
def squash(spark, d):
    key = text.squash(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", key.alias("key"), text.squash_space(F.col("p_name")).alias("spaceless"), text.shape(F.concat("p_name", F.lit(" 0158"))).alias("shape"), text.budget(key).alias("budget"))


@query(
    "within_budget",
    """WITH k AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS t FROM part),
            m AS (SELECT p_partkey, a, CASE p_partkey % 3 WHEN 0 THEN replace(a, 'e', 'x') WHEN 1 THEN a[2:] ELSE t END AS b FROM k)
       SELECT p_partkey, levenshtein(a, b) <= CASE WHEN length(b) < 5 THEN 0 ELSE length(b) // 4 END AS close FROM m""",
)
def within_budget(spark, d):
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    a, k = plain("p_name"), F.col("p_partkey") % 3
    b = F.when(k == 0, F.replace(a, F.lit("e"), F.lit("x"))).when(k == 1, F.substring(a, 2, 1000)).otherwise(plain("p_type"))
    return table(spark, d, "part").select("p_partkey", text.within_budget(a, b).alias("close"))


@query(
    "repair_digits",
    """WITH t AS (SELECT c_custkey, translate(c_custkey::VARCHAR, '01', 'Ol') || '7 B2B ' || translate(c_custkey::VARCHAR, '0', 'o') || ' Oil 2O24' AS t FROM customer)
       SELECT c_custkey, array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN regexp_full_match(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'), '[0-9OolIi]*[0-9][0-9OolIi]*') THEN translate(w, 'OolIi', '00111') ELSE w END), ' ') AS repaired FROM t""",
)
def repair_digits(spark, d):
    key = F.col("c_custkey").cast("string")
    t = F.concat(F.translate(key, "01", "Ol"), F.lit("7 B2B "), F.translate(key, "0", "o"), F.lit(" Oil 2O24"))
    return table(spark, d, "customer").select("c_custkey", text.repair_digits(t).alias("repaired"))


@query(
    "as_number",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN translate(c_custkey || '.5O', '15', 'lS') ELSE c_name END AS t FROM customer)
       SELECT c_custkey, CASE WHEN regexp_full_match(r, '[0-9]+[.]?[0-9]*') THEN r ELSE t END AS text, CASE WHEN t = '' THEN 'Blank' WHEN regexp_full_match(r, '[0-9]+[.]?[0-9]*') THEN 'Read' ELSE 'NotANumber' END AS status
       FROM (SELECT *, translate(t, 'OolIiSsZzBbGg', '0011155228866') AS r FROM t)""",
)
def as_number(spark, d):
    k = F.col("c_custkey") % 3
    t = F.when(k == 0, "").when(k == 1, F.translate(F.concat("c_custkey", F.lit(".5O")), "15", "lS")).otherwise(F.col("c_name"))
    value, status = text.insisted_number(t)
    return table(spark, d, "customer").select("c_custkey", value.alias("text"), status.alias("status"))


@query(
    "shortened",
    """SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE '…' || right(text, 39) END AS tail, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 39) || '…' END AS head,
              split_part(text, chr(10), 1) AS first_line FROM documents""",
)
def shortened(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.shorten_tail(t, 40).alias("tail"), text.shorten_head(t, 40).alias("head"), F.substring_index(t, "\n", 1).alias("first_line"))


@query(
    "escaped",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_sha256,
              CASE WHEN n = '' THEN 'file' ELSE n END AS name
       FROM (SELECT *, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS n FROM pages)""",
)
def escaped(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("html_sha256"), text.safe_name(F.col("url"), "file").alias("name"))


#: Letters of other scripts in place of Latin ones: documents that are Greek or Cyrillic for the most part, or Thai to half.
ALPHABETS = (("abcdefghilmnoprstuvxz", "αβγδεφγηιλμνοπρστυωξζ"), ("abcdeghiklmnoprstuvz", "абцдегхиклмнопрстувз"), ("aeionrst", "กขคงจชซฌ"))
MOVED = "CASE doc_id % 4 " + " ".join(f"WHEN {k + 1} THEN translate(text, '{a}', '{b}')" for k, (a, b) in enumerate(ALPHABETS)) + " ELSE text END"


def between(code: str, ranges) -> str:
    return "(" + " OR ".join(f"{code} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


LETTERS_SQL = f"""l AS (SELECT key, unnest(string_split(body, '')) AS letter FROM t),
  c AS (SELECT key, unicode(letter) AS c FROM l WHERE letter <> ''),
  s AS (SELECT key, CASE {" ".join(f"WHEN {between('c', ranges)} THEN {i}" for i, ranges in enumerate(text.SCRIPTS.values()))} ELSE 100 + (c >> 7) END AS place FROM c WHERE NOT {between("c", text.COMMON)} AND NOT {between("c", text.BLANK)}),
  n AS (SELECT key, place, CASE place {" ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(text.SCRIPTS))} ELSE 'Elsewhere ' || (place - 100) END AS script, count(*) AS n FROM s GROUP BY 1, 2)"""


def moved(text_):
    k = F.col("doc_id") % 4
    out = F.when(F.lit(False), text_)
    for i, (a, b) in enumerate(ALPHABETS):
        out = out.when(k == i + 1, F.translate(text_, a, b))
    return out.otherwise(text_)


@query("scripts", f"WITH t AS (SELECT doc_id AS key, {MOVED} AS body FROM documents), {LETTERS_SQL} SELECT doc_id, coalesce(script, 'Common') AS script FROM documents LEFT JOIN (SELECT key, arg_max(script, n * 100000 - place) AS script FROM n GROUP BY 1) ON key = doc_id")
def scripts(spark, d):
    """The script of each document, by all its letters."""
    return table(spark, d, "documents").select("doc_id", text.script(moved(F.col("text"))).alias("script"))


@query("script_votes", f"WITH t AS (SELECT doc_id AS key, {MOVED} AS body FROM documents), {LETTERS_SQL}, v AS (SELECT source, script, min(place) AS place, sum(n * n_chars) AS votes FROM n JOIN documents ON key = doc_id GROUP BY 1, 2) SELECT source, arg_max(script, votes * 100000 - place) AS script, max(votes)::BIGINT AS votes FROM v GROUP BY 1")
def script_votes(spark, d):
    """The script that leads in each source: every document votes with all its letters, by the weight of its length."""
    counts = table(spark, d, "documents").select("source", "n_chars", F.explode(text.script_counts(moved(F.col("text")))).alias("s"))
    votes = counts.groupBy("source", "s.script").agg(F.max("s.place").alias("place"), F.sum(F.col("s.n") * F.col("n_chars")).alias("votes"))
    return votes.groupBy("source").agg(F.max_by("script", F.struct("votes", "place")).alias("script"), F.max("votes").alias("votes"))


@query(
    "common_runs",
    """WITH k AS (SELECT p_partkey, p_name || p_brand AS a, CASE WHEN p_partkey % 3 = 0 THEN 'of ' || p_name || ' ' || p_type ELSE p_type END AS b FROM part)
       SELECT p_partkey, coalesce(max(n), 0)::INT AS run FROM (
         SELECT p_partkey, n, list_has_any(list_transform(range(1, length(a) - n + 2), lambda i: substr(a, i, n)), list_transform(range(1, length(b) - n + 2), lambda i: substr(b, i, n))) AS hit
         FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS n FROM k)) WHERE hit GROUP BY p_partkey
       UNION ALL SELECT p_partkey, 0 FROM k WHERE NOT list_has_any(string_split(a, ''), string_split(b, ''))""",
)
def common_runs(spark, d):
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("of "), "p_name", F.lit(" "), "p_type")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.common_run(F.concat("p_name", "p_brand"), other).alias("run"))


@query(
    "wrapped_lines",
    """WITH RECURSIVE w AS (SELECT p_partkey, list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand, '\\s+'), lambda x: x <> '') AS words FROM part),
            r AS (SELECT p_partkey, words, 1 AS i, []::VARCHAR[] AS lines, words[1] AS line FROM w
                  UNION ALL SELECT p_partkey, words, i + 1, CASE WHEN length(line || ' ' || words[i + 1]) <= 16 THEN lines ELSE list_append(lines, line) END, CASE WHEN length(line || ' ' || words[i + 1]) <= 16 THEN line || ' ' || words[i + 1] ELSE words[i + 1] END FROM r WHERE i < len(words))
       SELECT p_partkey, list_append(lines, line) AS lines, len(lines)::INT + 1 AS n_lines FROM r WHERE i = len(words)""",
)
def wrapped_lines(spark, d):
    lines = text.wrapped(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 16)
    return table(spark, d, "part").select("p_partkey", lines.alias("lines"), F.size(lines).alias("n_lines"))


@query(
    "label_lines",
    """SELECT doc_id, count(*) FILTER (trim(l) <> '') AS lines, count(*) FILTER (length(l) > 80) AS overfull FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""",
)
def label_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(F.trim("l") != "").alias("lines"), F.count_if(F.length("l") > 80).alias("overfull"))


@query(
    "civil_days",
    """SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS days, (DATE '1970-01-01' + date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT)::DATE AS date FROM orders""",
)
def civil_days(spark, d):
    days = F.unix_date(F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), F.date_from_unix_date(days).alias("date"))


@query(
    "times_as_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS short, strftime(ts, '%a, %d %b %Y %H:%M:%S UTC') AS rfc1123 FROM events""",
)
def times_as_text(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("short"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'UTC'").alias("rfc1123"))


@query(
    "relative_age",
    """SELECT event_id, CASE WHEN s <= 0 THEN 'just now' WHEN s <= 90 THEN s || ' s ago' WHEN s <= 5400 THEN (s // 60) || ' min ago' WHEN s <= 172800 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS age
       FROM (SELECT event_id, (event_id * 37) % 400000 - 50 AS s FROM events)""",
)
def relative_age(spark, d):
    return table(spark, d, "events").select("event_id", measure.relative_age((F.col("event_id") * 37) % 400_000 - 50).alias("age"))


@query(
    "time_left",
    """SELECT o_orderkey, CASE WHEN done >= 3 AND took >= 2 THEN round(took / done * (n - done), 6) END AS seconds_left FROM (SELECT o_orderkey, o_orderkey % 11 AS done, 20 AS n, (o_orderkey % 7)::DOUBLE AS took FROM orders)""",
)
def time_left(spark, d):
    done, took = F.col("o_orderkey") % 11, (F.col("o_orderkey") % 7).cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.when((done >= 3) & (took >= 2), F.round(took / done * (20 - done), 6)).alias("seconds_left"))


@query(
    "serial_dates",
    """WITH s AS (SELECT o_orderkey, ((o_orderkey * 7919) % 50000 - 3) + (o_orderkey % 4) * 0.25 AS v FROM orders),
            p AS (SELECT *, floor(v) AS day, ((v - floor(v)) * 86400)::INT AS sec FROM s),
            t AS (SELECT *, strftime((CASE WHEN day < 60 THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END + day::INT)::DATE, '%Y-%m-%d') AS date, printf('%02d:%02d:%02d', sec // 3600, (sec % 3600) // 60, sec % 60) AS time FROM p)
       SELECT o_orderkey, CASE WHEN v < 0 THEN NULL WHEN day = 0 THEN time WHEN sec = 0 THEN date ELSE date || ' ' || time END AS shown FROM t""",
)
def serial_dates(spark, d):
    v = (F.col("o_orderkey") * 7919) % 50_000 - 3 + (F.col("o_orderkey") % 4) * 0.25
    return table(spark, d, "orders").select("o_orderkey", measure.serial_date(v).alias("shown"))


@query(
    "label_slot",
    """SELECT o_orderkey, (o_orderkey + 5) // 24 AS sheet, ((o_orderkey + 5) % 24) // 3 AS row, ((o_orderkey + 5) % 24) % 3 AS col, ceil((o_orderkey + 5) / 24.0)::BIGINT AS sheets FROM orders""",
)
def label_slot(spark, d):
    sheet, row, col = measure.slot(F.col("o_orderkey"), 5, 3, 8)
    return table(spark, d, "orders").select("o_orderkey", sheet.alias("sheet"), row.alias("row"), col.alias("col"), measure.sheets_needed(F.col("o_orderkey"), 5, 24).alias("sheets"))


@query("sheet_side", """SELECT l_orderkey, l_linenumber, 2 * l_orderkey - 1 + (l_linenumber % 2 = 0)::INT AS page, (greatest(l_orderkey - l_linenumber, 1) + 1) // 2 AS sheet, greatest(l_orderkey - l_linenumber, 1) % 2 = 0 AS back, (l_orderkey + 1) // 2 AS sheets FROM lineitem""")
def sheet_side(spark, d):
    k = F.col("l_orderkey")
    sheet, back = measure.sheet_and_back(k - F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", measure.page_of(k, F.col("l_linenumber") % 2 == 0).alias("page"), sheet.alias("sheet"), back.alias("back"), measure.sheets_for(k).alias("sheets"))


@query("turned_backs", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN b THEN 210 - x ELSE x END, 6)::DOUBLE AS x, round(CASE WHEN b THEN 297 - y ELSE y END, 6)::DOUBLE AS y, (l_suppkey % 4 * 90 + CASE WHEN b THEN 180 ELSE 0 END)::DOUBLE AS rotation FROM (SELECT *, l_quantity * 4 AS x, l_tax * 1000 AS y, l_orderkey % 3 = 0 AND l_linenumber % 2 = 0 AS b FROM lineitem)""")
def turned_backs(spark, d):
    """Placements on backs, of which a third of all printers turn the sheet around."""
    around = (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") % 2 == 0)
    t = measure.turned(F.col("l_quantity") * 4, F.col("l_tax") * 1000, (F.col("l_suppkey") % 4 * 90).cast("double"), F.lit(210.0), F.lit(297.0), around)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(t["x"], 6).alias("x"), F.round(t["y"], 6).alias("y"), t["rotation"].alias("rotation"))


@query(
    "shaped_like",
    """WITH s(name, w, h, place) AS (VALUES ('A3', 297.0, 420.0, 1), ('A4', 210.0, 297.0, 2), ('A5', 148.0, 210.0, 3), ('Letter', 215.9, 279.4, 4), ('Legal', 215.9, 355.6, 5))
       SELECT p_partkey, name, place FROM part, s WHERE abs((1.0 + p_size / 70.0) - h / w) <= 0.02 * (h / w)""",
)
def shaped_like(spark, d):
    sheets = spark.createDataFrame([(n, w, h, i) for i, (n, w, h) in enumerate(measure.SHEETS, 1)], "name string, w double, h double, place int")
    parts = table(spark, d, "part").withColumn("aspect", 1.0 + F.col("p_size") / 70.0)
    hit = F.abs(F.col("aspect") - F.col("h") / F.col("w")) <= 0.02 * (F.col("h") / F.col("w"))
    return parts.join(F.broadcast(sheets), hit).select("p_partkey", "name", "place")  # five fixed rows


@query("digests", """SELECT page_id, sha256(html) AS sha256, length(html) AS n FROM pages""")
def digests(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.length("html").cast("long").alias("n"))


@query(
    "half_l1",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings)
       SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] / list_sum(a.v) - z[2] / list_sum(b.v)))) / 2, 6) AS distance,
              round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2]))) / list_sum(list_transform(list_zip(a.v, b.v), lambda z: greatest(z[1], z[2]))), 6) AS jaccard
       FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def half_l1(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("v"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(other, "vec_id").select("vec_id", F.round(measure.half_l1(F.col("v"), F.col("w")), 6).alias("distance"), F.round(measure.weighted_jaccard(F.col("v"), F.col("w")), 6).alias("jaccard"))


@query(
    "pooled_blocks",
    """WITH c AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i))
       SELECT vec_id, (i // 8 // 4) * 2 + (i % 8) // 4 AS block, round(avg(x), 6) AS mean FROM c GROUP BY ALL""",
)
def pooled_blocks(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(measure.pooled(v, 8, 4)).alias("block", "mean"))
    return out.select("vec_id", F.col("block").cast("long"), F.round("mean", 6).alias("mean"))


FIT = {"rotation": 2.0, "scale": 1.01, "dx": 3.0, "dy": -4.0}


@query(
    "similarity_points",
    """WITH p AS (SELECT s_suppkey, (s_suppkey % 200)::DOUBLE AS x, s_acctbal / 50 AS y FROM supplier), u AS (SELECT *, x - 105 AS ux, y - 148.5 AS uy, radians(2.0) AS a FROM p)
       SELECT s_suppkey, round(1.01 * (ux * cos(a) - uy * sin(a)) + 105 + 3, 6) AS x1, round(1.01 * (ux * sin(a) + uy * cos(a)) + 148.5 - 4, 6) AS y1, round(x, 6) AS x0, round(y, 6) AS y0 FROM u""",
)
def similarity_points(spark, d):
    fit, centre = {k: F.lit(v) for k, v in FIT.items()}, (105.0, 148.5)
    x, y = (F.col("s_suppkey") % 200).cast("double"), F.col("s_acctbal") / 50
    x1, y1 = measure.apply_similarity(x, y, fit, centre)
    x0, y0 = measure.undo_similarity(x1, y1, fit, centre)
    return table(spark, d, "supplier").select("s_suppkey", *[F.round(c, 6).alias(n) for n, c in (("x1", x1), ("y1", y1), ("x0", x0), ("y0", y0))])


@query(
    "nearness",
    """SELECT l_orderkey, l_linenumber, round(exp(-0.5 * ((l_quantity - 25) / 4) ** 2), 6) AS near, round(sqrt(l_quantity ** 2 + (l_tax * 100) ** 2), 6) AS miss FROM lineitem""",
)
def nearness(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(measure.nearness(F.col("l_quantity"), F.lit(25.0), 4.0), 6).alias("near"), F.round(F.hypot(F.col("l_quantity"), F.col("l_tax") * 100), 6).alias("miss"))


@query(
    "blank_capacity",
    """SELECT p_partkey, least(greatest(p_size * 0.7 * 72 / 25.4, 6), 24) AS pt, floor(p_retailprice / (least(greatest(p_size * 0.7 * 72 / 25.4, 6), 24) * 0.5))::BIGINT AS characters FROM part""".replace("least(greatest(p_size * 0.7 * 72 / 25.4, 6), 24) AS pt", "round(least(greatest(p_size * 0.7 * 72 / 25.4, 6), 24), 6)::DOUBLE AS pt"),
)
def blank_capacity(spark, d):
    pt = F.least(F.greatest(F.col("p_size") * 0.7 * 72 / 25.4, F.lit(6.0)), F.lit(24.0))
    return table(spark, d, "part").select("p_partkey", F.round(pt, 6).alias("pt"), F.floor(F.col("p_retailprice") / (pt * 0.5)).alias("characters"))


@query(
    "overlaps",
    """SELECT l_orderkey, l_linenumber, CASE WHEN least(10.0, l_quantity) > 0 THEN round(greatest(least(10.0, l_discount * 100 + l_quantity) - greatest(0.0, l_discount * 100), 0) / least(10.0, l_quantity), 6) ELSE 0 END::DOUBLE AS share FROM lineitem""",
)
def overlaps(spark, d):
    x = F.col("l_discount") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(measure.overlap(F.lit(0.0), F.lit(10.0), x, x + F.col("l_quantity")), 6).alias("share"))


@query("saturating_sums", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 9223372036854775807 ELSE 9223372036854775800 - p_size END AS total FROM part""")
def saturating_sums(spark, d):
    a, size = F.lit((1 << 63) - 8), F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", measure.saturating_add(a, F.when(F.col("p_partkey") % 2 == 0, size + 10).otherwise(-size)).alias("total"))


@query(
    "numerals",
    """WITH n AS (SELECT p_partkey, least(greatest(p_partkey, 1), 3999)::INT AS n, p_size::INT AS s FROM part)
       SELECT p_partkey, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
              CASE WHEN s > 26 THEN chr(96 + (s - 1) // 26) ELSE '' END || chr(97 + (s - 1) % 26) AS letters FROM n""",
)
def numerals(spark, d):
    return table(spark, d, "part").select("p_partkey", measure.roman(F.col("p_partkey")).alias("roman"), measure.letters(F.col("p_size")).alias("letters"))
