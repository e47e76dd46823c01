"""The queries of this package, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, common, counts, ctw, jpeg, licenses, mixing, ordinal, quality, repair, simhash, toxicity, trie, urls


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file on the machine that asks: in the folder that TALLYFRAME_TOKENIZERS names, or where the
    package of public tokenizers has it. The files are not part of this package."""
    named = os.environ.get("TALLYFRAME_TOKENIZERS")
    if named:
        return os.path.join(named, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"], with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), common.training_row(F.col("doc_id"), 5))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"], name="score")
    return scored.select("doc_id", (~common.training_row(F.col("doc_id"), 3)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of op6: a host and the beginning of a path, and the verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels), keep=["doc_id"])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return ordinal.grade_texts(docs, ordinal.fit(docs, labels, grade, 3), keep=["doc_id"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(jpeg.store(table(spark, sf_dir, "documents"), keep=["doc_id"]), keep=["doc_id"])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / thousands / hundreds / id; one with a statement of licence on any line stands for
    a licence file of its source, thousand or hundred, by its id."""
    docs = table(spark, sf_dir, "documents")
    parts = F.array(F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.pmod("doc_id", F.lit(1000)) / 100).cast("string"))
    states = F.coalesce(F.col("text").rlike(r"(?i)\blicen[cs]ed?\b"), F.lit(False))
    level = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    path = F.when(states, F.concat(F.array_join(F.slice(parts, 1, level), "/"), F.lit("/LICENSE-"), F.col("doc_id"))).otherwise(F.concat_ws("/", F.array_join(parts, "/"), F.col("doc_id").cast("string")))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id", "path"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.encoded(table(spark, sf_dir, "conversations"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(conversations), conversations)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), lambda: vocabulary("word_bpe_49k.json"), limit=2048, keep=["doc_id"])


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_mixing": op2_mixing,
        "op3_ctw": op3_ctw,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_url_filter": op6_url_filter,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_media": op9_media,
        "op10_licenses": op10_licenses,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_repair": op12_repair,
        "op13_token_counts": op13_token_counts,
    }


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
bounds AS (SELECT *, 3.0::DOUBLE * source_size AS bound, 3.0::DOUBLE * source_size / weight AS ratio FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bounds),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
shares AS (SELECT source, source_size, CASE WHEN c.level IS NULL THEN bound ELSE least(bound, weight * c.level) END AS target FROM levels, chosen c),
drawn AS (
  SELECT doc_id, source, size,
         ('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized),
bins AS (SELECT source, floor(u * 16384)::BIGINT AS step, sum(size)::BIGINT AS size FROM drawn GROUP BY 1, 2),
rates AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction, target - floor(rate)::BIGINT * source_size AS wanted,
         ('0x' || substr(md5('7/of/' || coalesce(source, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * source_size AS "from"
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM shares)),
starts AS (SELECT source, step, (sum(size) OVER (PARTITION BY source ORDER BY step) - size)::BIGINT AS start FROM bins WHERE size > 0),
offs AS (
  SELECT s.source, s.step, s.start - r."from" + CASE WHEN s.start < r."from" THEN r.source_size ELSE 0 END AS off, r.wanted
  FROM starts s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
ends AS (SELECT source, arg_min(step, off) FILTER (off < wanted) AS low, arg_min(step, off) FILTER (off >= wanted) AS high FROM offs GROUP BY source),
rated AS (
  SELECT doc_id, size, source_size, target, fraction,
         (whole + CASE WHEN low IS NULL THEN 0 WHEN high IS NULL THEN 1
                       WHEN low < high THEN (floor(u * 16384) >= low AND floor(u * 16384) < high)::INT
                       ELSE (floor(u * 16384) >= low OR floor(u * 16384) < high)::INT END)::BIGINT AS copies
  FROM drawn JOIN rates ON drawn.source IS NOT DISTINCT FROM rates.source LEFT JOIN ends ON drawn.source IS NOT DISTINCT FROM ends.source)
SELECT doc_id, size, source_size, target, fraction, copies, (size * copies)::BIGINT AS taken
FROM rated
"""


OP6_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op10_sql() -> str:
    """Weights come from the templates' texts and the documents alone."""
    templates = ", ".join(f"({t}, {quoted(name)}, {quoted(text)})" for t, (name, text) in enumerate(licenses.TEMPLATES))

    def terms(text: str) -> str:
        lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all(regexp_replace({lower}, {quoted(licenses.TAG)}, 'spdx-license-identifier:', 'g'), {quoted(licenses.TERM)})"

    return rf"""
WITH templates(t, license, body) AS (VALUES {templates}),
files AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(regexp_matches(text, '(?i)\blicen[cs]ed?\b'), false) AS whole,
         [coalesce(source, 'none'), floor(doc_id / 1000)::BIGINT::VARCHAR, floor((doc_id % 1000) / 100)::BIGINT::VARCHAR] AS parts
  FROM documents),
placed AS (
  SELECT *, array_to_string(parts[1:CASE WHEN whole THEN doc_id % 3 + 1 ELSE 3 END], '/') AS dir,
         array_to_string(parts[1:CASE WHEN whole THEN doc_id % 3 + 1 ELSE 3 END], '/') || CASE WHEN whole THEN '/LICENSE-' ELSE '/' END || doc_id AS path
  FROM files),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM placed),
said AS (SELECT r, min(pos) AS said FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(line, {quoted(licenses.COMMENT)}) GROUP BY r),
headers AS (
  SELECT r, string_agg(regexp_replace(line, {quoted(licenses.MARKS)}, '', 'g'), chr(10) ORDER BY pos) AS header
  FROM lines LEFT JOIN said USING (r) WHERE pos < coalesce(said, pos + 1) GROUP BY r),
units AS (
  SELECT r, unit, row_number() OVER () AS u FROM (
    SELECT r, line AS unit FROM lines
    UNION ALL SELECT r, header FROM headers WHERE trim(header) <> ''
    UNION ALL SELECT r, unnest(string_split_regex(header, {quoted(licenses.BETWEEN)})) FROM headers WHERE trim(header) <> ''
    UNION ALL SELECT r, text FROM placed WHERE whole
    UNION ALL SELECT r, unnest(string_split_regex(text, {quoted(licenses.BETWEEN)})) FROM placed WHERE whole)),
has AS (SELECT r, u, word, count(*)::DOUBLE AS times FROM (SELECT r, u, unnest({terms("unit")}) AS word FROM units) GROUP BY r, u, word),
total AS (SELECT count(DISTINCT u) AS n FROM has),
own_terms AS (SELECT t, license, word, count(*)::DOUBLE AS times FROM (SELECT t, license, unnest({terms("body")}) AS word FROM templates) GROUP BY t, license, word),
frequencies AS (SELECT word, count(*) AS df FROM has GROUP BY word),
idf AS (
  SELECT word, ln((1 + (SELECT n FROM total))::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT word FROM has UNION SELECT word FROM own_terms) LEFT JOIN frequencies USING (word)),
norms AS (SELECT u, sum((times * idf) * (times * idf)) AS norm FROM has JOIN idf USING (word) GROUP BY u),
own_norms AS (SELECT t, sum((times * idf) * (times * idf)) AS norm FROM own_terms JOIN idf USING (word) GROUP BY t),
scored AS (
  SELECT h.r, h.u, o.t, o.license, round(sum(h.times * i.idf * o.times * i.idf) / sqrt(any_value(n.norm) * any_value(m.norm)), 6) AS score
  FROM has h JOIN own_terms o USING (word) JOIN idf i USING (word) JOIN norms n ON n.u = h.u JOIN own_norms m ON m.t = o.t GROUP BY h.r, h.u, o.t, o.license),
best AS (SELECT r, license, score FROM scored WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
own AS (SELECT p.*, b.license, b.score FROM placed p LEFT JOIN best b USING (r)),
owners AS (
  SELECT dir AS up, path AS owner, license AS given, score AS given_score FROM own WHERE whole AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
above AS (
  SELECT dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda n: array_to_string(string_split(dir, '/')[1:n], '/'))) AS up
  FROM (SELECT DISTINCT dir FROM own)),
nearest AS (SELECT a.dir, o.* EXCLUDE up FROM above a JOIN owners o USING (up) QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(a.up) DESC) = 1)
SELECT doc_id, path, coalesce(license, given) AS license, coalesce(score, given_score) AS score, CASE WHEN license IS NOT NULL THEN path ELSE owner END AS found_in
FROM own LEFT JOIN nearest USING (dir)
"""


#: CRC-32 of a conversation's number, a bit at a time.
OP11_SQL = r"""
WITH RECURSIVE numbers AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS said FROM conversations WHERE conv_id IS NOT NULL),
crc(c, said, i, reg) AS (
  SELECT c, said, 0, 4294967295::BIGINT FROM numbers
  UNION ALL
  SELECT c, said, i + 1, CASE WHEN i % 9 = 0 THEN xor(reg, ord(said[i // 9 + 1])::BIGINT) WHEN reg % 2 = 1 THEN xor(reg // 2, 3988292384::BIGINT) ELSE reg // 2 END
  FROM crc WHERE i < 9 * length(said)),
convs AS (SELECT c, c - c % 5 AS base, xor(reg, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = 9 * length(said)),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
mixed AS (
  SELECT v.c, 0 AS own, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.place <= v.h
  UNION ALL
  SELECT v.c, 1, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.place > v.h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, place) AS d, role, text FROM mixed),
sequences AS (SELECT c, list(md5(length(role) || ':' || role || text) ORDER BY d) AS ids, list(strlen(text) ORDER BY d) AS sizes FROM rebuilt GROUP BY c),
whole AS (SELECT v.c, coalesce(s.ids, []) AS ids, coalesce(s.sizes, []) AS sizes FROM convs v LEFT JOIN sequences s USING (c)),
members AS (SELECT c, d, array_to_string(ids[1:d], ',') AS key, len(ids) AS n, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM whole, unnest(range(len(ids) + 1)) AS u(d)),
nodes AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY key, d),
linked AS (SELECT n.*, p.conv_id AS parent FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d = n.d LEFT JOIN members a ON a.c = n.conv_id AND a.d = n.d - 1 LEFT JOIN nodes p ON p.key = a.key AND p.d = a.d),
children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
sums AS (
  SELECT a.key, a.d, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((t.n_convs - 1) * t.size) AS saved
  FROM linked t LEFT JOIN children k ON k.parent = t.conv_id AND k.d = t.d JOIN members a ON a.c = t.conv_id AND a.d <= t.d GROUP BY 1, 2)
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent AS parent_conv_id, l.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN sums s ON s.key = l.key AND s.d = l.d LEFT JOIN children k ON k.parent = l.conv_id AND k.d = l.d
"""


#: The cheapest edits by going forward through each conversation, with the best edits so far for each state.
OP12_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations),
crc(said, i, reg) AS (
  SELECT said, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT said, i + 1, CASE WHEN i % 9 = 0 THEN xor(reg, ord(said[i // 9 + 1])::BIGINT) WHEN reg % 2 = 1 THEN xor(reg // 2, 3988292384::BIGINT) ELSE reg // 2 END
  FROM crc WHERE i < 9 * length(said)),
kinds AS (SELECT said, xor(reg, 4294967295::BIGINT) % 20 AS kind FROM crc WHERE i = 9 * length(said)),
damaged AS (
  SELECT conv_id AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(nullif(role, ''), ' ') END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN kinds ON said = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place, role[1] AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY place) AS last
  FROM ordered),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (place > 1 AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c),
due(s, t, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserted(s, t, cost, said, lines) AS (
  SELECT s, s, 0, '', '' FROM due UNION ALL SELECT s, t, 5, 'I', role || ':' || chr(10) FROM due
  UNION ALL SELECT a.s, b.t, 10, 'II', a.role || ':' || chr(10) || b.role || ':' || chr(10) FROM due a JOIN due b ON b.s = a.t),
edits(edit) AS (VALUES ('D'), ('K'), ('R')),
best(c, i, s, cost, audit, body) AS (
  SELECT c, 0::BIGINT, '', 0::BIGINT, '', '' FROM counts
  UNION ALL
  SELECT c, i, s, cost, audit, body FROM (
    SELECT b.c, r.place AS i, CASE edit WHEN 'D' THEN x.t WHEN 'K' THEN r.initial ELSE d.t END AS s,
           b.cost + x.cost + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           b.audit || x.said || edit AS audit, b.body || x.lines || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE d.role || ':' || r.text || chr(10) END AS body
    FROM best b JOIN judged r ON r.c IS NOT DISTINCT FROM b.c AND r.place = b.i + 1 JOIN inserted x ON x.s = b.s JOIN due d ON d.s = x.t, edits
    WHERE edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR r.initial = d.t OR (r.initial = 's' AND x.t = ''))))
  QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) = 1),
ended AS (
  SELECT b.c, b.cost + x.cost AS cost, b.audit || x.said AS audit, b.body || x.lines AS body
  FROM best b JOIN counts n ON n.c IS NOT DISTINCT FROM b.c AND b.i = n.n JOIN inserted x ON x.s = b.s WHERE x.t IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY b.cost + x.cost, b.audit || x.said) = 1)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts n ON n.c IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.c IS NOT DISTINCT FROM v.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_repair": OP12_SQL, "op11_prefix_trie": OP11_SQL, "op10_licenses": op10_sql(), "op2_mixing": OP2_SQL, "op6_url_filter": OP6_SQL}
