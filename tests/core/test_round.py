"""Scripts and directions of whole texts, near ties over long lists, options and specs in columns, checks of jobs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.functions import options, text
from tallyframe.functions.template import field_spec
from tallyframe.operators import checks, fits, rank
from tallyframe.sources import lists
from tallyframe.streaming import arrivals


def classed(ch):
    c = ord(ch)
    if any(a <= c <= b for a, b in (*text.COMMON, *text.BLANK)):
        return None
    return next((name for name, ranges in text.SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), f"Elsewhere {c >> 7}")


def test_scripts_of_whole_texts(spark):
    texts = ["abc", "1. абв", "aб", "бa", "12 ?!", "", None, "日本語のテキスト", "ひらがな漢", "한국어 ok", "\U00020000\U00020001", "ქართული ab", "\U0001f600\U0001f601 a", "हिन्दी", "ไทย", "ລາວ", "שלום", "مرحبا abc", "x" * 5000 + "я" * 5001, "ༀༀ ქ"]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.script(F.col("t")).alias("s")).orderBy("i").collect()]
    order = [*text.SCRIPTS]
    for t, s in zip(texts, got, strict=True):
        votes = Counter(x for x in map(classed, t or "") if x)
        key = lambda x: (-votes[x], order.index(x) if x in order else 100 + int(x.split()[1]))
        assert s == (min(votes, key=key) if votes else "Common"), t


def test_lines_are_turned_round_where_most_letters_run_leftward(spark):
    lines = ["שלום עולם", "שלום abcdefg", "abc def", "אב 12 גד", "", "12 34", "مرحبا بك ok"]
    got = [r["s"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", text.as_read(F.col("t")).alias("s")).orderBy("i").collect()]
    for line, said in zip(lines, got, strict=True):
        left = sum("֐" <= c <= "ࣿ" for c in line)
        right = sum(c.isalpha() for c in line) - left
        assert said == (" ".join(w[::-1] for w in line.split(" ")[::-1]) if left > right else line)


def held(scores, within=0.02):
    at = None
    for i, s in enumerate(scores):
        if s is not None and (at is None or s > scores[at] * (1 + within)):
            at = i
    return at


def test_near_ties_of_long_lists(spark):
    rng = random.Random(3)
    lists = {"random": [rng.uniform(1, 9) for _ in range(2_000)], "rising": [1.001**i for i in range(3_000)], "steps": [1.02**i for i in range(60)], "falling": [5.0 - i / 1000 for i in range(900)], "one": [2.0], "ties": [1.0, 1.0, 1.02, 1.02, 1.0200001, 1.05, 1.05], "nulls": [None, 3.0, None, 4.0], None: [1.0, 5.0]}
    rows = [(g, i, s, f"{g}{i}") for g, scores in lists.items() for i, s in enumerate(scores)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, s double, name string").repartition(5)
    got = {r["g"]: r["name"] for r in rank.near_ties(df, ["g"], "o", "s", "name").collect()}
    assert got == {g: f"{g}{held(scores)}" for g, scores in lists.items()}


def test_densest_stretch(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.uniform(-9, 9), rng.randrange(-4, 4) / 4])) for g in "aab" for _ in range(300)] + [("c", None), ("d", 1.0)]
    got = {r["g"]: (r["mode"], r["held"]) for r in fits.densest(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 0.25).collect()}
    for g in "abd":
        xs = [x for k, x in rows if k == g]
        best = max(xs, key=lambda x: (sum(x <= y <= x + 0.25 for y in xs), -x))
        inside = [y for y in xs if best <= y <= best + 0.25]
        assert got[g][1] == len(inside) and abs(got[g][0] - sum(inside) / len(inside)) < 1e-9
    assert set(got) == {"a", "b", "d"}


def test_repeats_of_a_hot_fingerprint(spark):
    rows = [("hot" if i % 3 else f"f{i % 50}", i) for i in range(900)] + [(None, 901), (None, 905)]
    got = {r["at"]: r["seen_at"] for r in arrivals.repeats(spark.createDataFrame(rows, "k string, at int"), "k", "at").collect()}
    last: dict = {}
    for k, i in rows:
        assert got[i] == last.get(k)
        last[k] = i


def test_options_and_specs_in_columns(spark):
    runs = spark.createDataFrame([(1, 0.5, None, None, 1), (2, None, 0.7, 0.0, 2), (3, 30.0, None, None, 3), (4, None, None, 101.0, 4)], "k int, given_tolerance double, own_tolerance double, own_pad double, tolerances int")
    got = {r["k"]: r for r in options.laid_over(runs, ["given_", "own_"]).collect()}
    assert [got[k]["tolerance"] for k in (1, 2, 3)] == [0.5, 0.7, 30.0] and [got[k]["refused"] for k in (1, 2, 3, 4)] == [None, None, "tolerance", "pad"] and got[1]["pad"] == 0.3
    specs = ["Name", "Total=Amount due/number", "Date/below", "N=a/b/below/number", " Sum = To pay /after ", "x/number/below", "x/below/after", "a/b", "a=b=c/number"]
    f = options.field_of(F.col("spec"))
    rows = spark.createDataFrame([(s,) for s in specs], "spec string").select("spec", f.alias("f")).collect()
    for r in rows:
        want = field_spec(r["spec"])
        assert tuple(r["f"]) == (want["name"], want["label"], want["place"], want["number"]), r["spec"]


def job_tables(spark):
    """1: sound; 2: a page more, another size, ink moved; 3: swapped; 4: the same; 5: a page gone and near the edge, much covered."""
    sizes = "job int, page int, width double, height double"
    before = spark.createDataFrame([(j, p, 210.0, 297.0) for j in range(1, 6) for p in (1, 2)], sizes)
    now = spark.createDataFrame([(j, p, 148.0 if (j, p) == (2, 2) else 210.2, 297.1) for j in range(1, 6) for p in ((1, 2, 3) if j == 2 else (1,) if j == 5 else (1, 2))], sizes)
    added = spark.createDataFrame([(1, 1, 50.0, 100.0, 90.0, 106.0, 3.0), (2, 1, 50.0, 100.0, 90.0, 106.0, 3.0), (5, 1, 4.0, 100.0, 40.0, 106.0, 3.0), (5, 1, 0.5, 120.0, 40.0, 126.0, 12_474.0)], "job int, page int, x0 double, y0 double, x1 double, y1 double, ink double")
    removed = spark.createDataFrame([(1, 2, 20.0, 1.4), (2, 1, 30.0, 1.0), (2, 1, 20.0, 0.6), (3, 2, 20.0, 9.0)], "job int, page int, y0 double, ink double")
    jobs = spark.createDataFrame([(j, "p" if j < 3 else None) for j in range(1, 6)], "job int, profile string")
    return jobs, before, now, added, removed


def test_all_checks_of_jobs(spark):
    jobs, before, now, added, removed = job_tables(spark)
    found = checks.everything(jobs, before, now, added, removed)
    got: dict = {}
    for r in checks.to_read(found).orderBy("job", "place").collect():
        got.setdefault(r["job"], []).append((r["severity"], r["code"], r["page"], r["detail"] and round(r["detail"], 3)))
    assert got == {
        1: [("note", "calibrated", 0, None)],
        2: [("blocker", "reflow", 1, 20.0), ("blocker", "page_size_mismatch", 2, 62.0), ("warning", "pages_added", 0, 1.0), ("note", "calibrated", 0, None)],
        3: [("blocker", "documents_reversed", 0, 9.0), ("blocker", "reflow", 2, 20.0), ("note", "uncalibrated", 0, None)],
        4: [("blocker", "empty_delta", 0, None), ("note", "uncalibrated", 0, None)],
        5: [("blocker", "pages_removed", 0, 1.0), ("warning", "large_delta", 1, 0.2), ("warning", "margin", 1, 0.5), ("note", "uncalibrated", 0, None)],
    }
    codes = {(r["job"], r["code"]) for r in checks.without_symptoms(found).collect()}
    assert (3, "reflow") not in codes and (2, "reflow") in codes and (3, "documents_reversed") in codes
    assert {tuple(r) for r in checks.verdicts(jobs, found).collect()} == {(1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, True, False)}
    assert {(r["job"], r["code"], r["detail"]) for r in checks.split(found).collect() if r["code"].startswith("reflow")} == {(2, "reflow_split", 1.0), (3, "reflow_split", 1.0)}
    assert checks.margins(added, before, 0.0).count() == 0
    assert checks.everything(*[t.limit(0) for t in (jobs, before, now, added, removed)]).count() == 0


def test_lists_keep_separators_and_escapes_of_their_own(spark):
    cells = ["a\u001fb", "\u001e", "\ufdd0", "\ufdd0a", "\ufdd0b\ufdd1", "\ufdd1c", "x\ufdd0\u001f\ufdd0"]
    content = ",".join(f'"{c}"' for c in cells) + "\n" + ",".join(cells) + "\n"
    got = lists.records(spark.createDataFrame([("p", content)], "path string, content string")).orderBy("at").collect()
    assert [r["cells"] for r in got][:2] == [cells, cells]
