"""Operators that no longer gather groups, against plain versions, with their bounds set low."""

import itertools
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import components, extract, fits, greedy, islands, marks, scan, sets, spatial, tables
from tallyframe.operators.store import NoSuchName, Store, run_job


@pytest.mark.parametrize("most", [100_000, 50])
def test_elements_of_groups_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(fits, "MOST", most)
    rng = random.Random(3)
    groups = {"wide": [rng.random() for _ in range(3_000)], "tied": [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(2_000)], "hot": [5.0] * 1_500 + [rng.random() * 10 for _ in range(700)], "one": [4.0], "none": [None, None], "twelve": [float(i % 5 + 1) for i in range(12)]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double").repartition(5)
    got = {r["g"]: r for r in fits.indexed_quantiles(df, ["g"], "x").collect()}
    dev = {r["g"]: r["deviation"] for r in fits.trimmed_deviation(df, ["g"], "x").collect()}
    for g, xs in groups.items():
        v = sorted(x for x in xs if x is not None)
        if not v:
            assert g not in got
            continue
        n = len(v)
        assert (got[g]["n"], got[g]["lower"], got[g]["median"], got[g]["upper"]) == (n, v[n // 4], v[n // 2], v[3 * n // 4])
        kept, m = v[n // 10 : n - n // 10], v[n // 2]
        want = sum(abs(x - m) / m for x in kept) / len(kept) if n >= 12 else None
        assert dev[g] is None if want is None else abs(dev[g] - want) < 1e-9


def brute_regions(cells):
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        part = []
        while todo:
            p, x, y = todo.pop()
            part.append((y, x, p))
            for q in [(p, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        first = min(part)
        out |= {(p, x, y): first[:2] for y, x, p in part}
    return out


@pytest.mark.parametrize("tile", [64, 4, 1])
def test_regions_over_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(spatial, "TILE", tile)
    rng = random.Random(5)
    cells = {(p, rng.randrange(-20, 30), rng.randrange(-20, 30)) for p in (0, 1) for _ in range(700)}
    cells |= {(7, x, 0) for x in range(150)} | {(7, 149, y) for y in range(150)} | {(7, x, 149) for x in range(2, 150)}  # a winding one
    rows = spark.createDataFrame([*cells], "page int, gx long, gy long").repartition(7)
    got = {(r["page"], r["gx"], r["gy"]): (r["root"]["gy"], r["root"]["gx"]) for r in spatial.roots(rows, "page").collect()}
    assert got == brute_regions(cells)
    assert spatial.roots(rows.limit(0), "page").count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def test_boxes_merge_like_one_after_the_other(spark):
    rng = random.Random(9)
    boxes = [(p, i, x, y, x + rng.random() * 9, y + rng.random() * 9) for p in (1, 2) for i in range(120) for x, y in [(rng.random() * 150, rng.random() * 150)]]
    got = Counter((r["page"], round(r["x0"], 9), round(r["y0"], 9), round(r["x1"], 9), round(r["y1"], 9)) for r in spatial.merged_boxes(spark.createDataFrame(boxes, "page int, id int, x0 double, y0 double, x1 double, y1 double"), "page", 16.0).collect())
    want = Counter()
    for p in (1, 2):
        held = [b[2:] for b in boxes if b[0] == p]
        moved = True
        while moved:
            moved = False
            for i in range(len(held)):
                for j in range(i):
                    a, b = held[i], held[j]
                    if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                        held[j] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                        del held[i]
                        moved = True
                        break
                if moved:
                    break
        want.update((p, *(round(v, 9) for v in b)) for b in held)
    assert got == want


def words(spark, *lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "sheet int, t string")
    return extract.placed_words(df, "sheet", "t")


def test_phrases_of_any_number_of_words(spark):
    nine = "one two three four five six seven eight nine"
    w = words(spark, f"a {nine} z", "o n e t w o three - four, five: six (seven) eight nine!", nine[:-1], f"{nine}\n{nine}", "x " * 40 + nine.replace("five", "fivve"))
    got = {(r["sheet"], r["line"]): (r["first"], r["last"]) for r in extract.phrase_hits(w, nine, 0).collect()}
    assert got == {(0, 0): (1, 9), (1, 0): (0, 13), (3, 0): (0, 8), (3, 1): (0, 8)}
    assert {r["sheet"]: r["status"] for r in extract.resolve_anchor(w, nine).collect()} == {0: "Found", 1: "Found", 2: "Found", 3: "Ambiguous", 4: "Found"}
    label = "the number that is written on the front of the card"
    picked = extract.pick_fields(words(spark, f"{label}: 12 34", "nothing"), [{"name": "n", "label": label, "place": "after"}])
    assert {r["sheet"]: (r["status"], r["text"]) for r in picked.collect()} == {0: ("Read", "12 34"), 1: ("NoLabel", None)}


def test_names_are_found_exactly_or_inside(spark):
    names = ["Arial Black", "Arial", "Liberation Serif", "DejaVu Sans", "Ünïcode Face", "!!", "arial-narrow", "ab"]
    wanted = ["ARIAL", "arialb", "serif", "nothing like it", "", "--", "face", "a", "ünï", "Arial Narrow", "b", "zz"]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r["w"]: r["i"] for r in sets.by_name(spark.createDataFrame([(w,) for w in wanted], "w string"), "w", table, "n", "i").collect()}
    squash = lambda t: "".join(c for c in t if c.isalnum()).lower()
    for w in wanted:
        key = squash(w)
        hits = [i for i, n in enumerate(names) if key and squash(n) == key] or [i for i, n in enumerate(names) if key and key in squash(n)]
        assert got[w] == (hits[0] if hits else None), w


def test_every_kind_gets_the_rows_for_all(spark):
    df = spark.createDataFrame([(1, "amd64"), (2, "all"), (3, "sparc"), (4, "all"), (5, "mips")], "k int, arch string")
    got = Counter((r["target"], r["k"]) for r in sets.for_every(df, "arch", "all").collect())
    assert got == Counter([("amd64", 1), ("sparc", 3), ("mips", 5), ("all", 2), ("all", 4)] + [(a, k) for a in ("amd64", "sparc", "mips") for k in (2, 4)])
    assert sets.for_every(df.filter("arch = 'all'"), "arch", "all").count() == 2


def test_texts_that_contain_an_item(spark):
    docs = ["the quick brown fox jumps", "quick  brown", "xthe quick brown foxes", "", None, "brown fox", "a b", "fox", "one\ntwo three four five six seven eight nine ten eleven twelve"]
    items = ["the quick brown fox", "brown fox", "fox", "quick  brown", "o", "", None, "b", "two three four five six seven eight nine ten eleven", "nowhere in here at all", "x"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, text string")
    w = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item int, text string")
    got = Counter((r["item"], r["id"]) for r in sets.containing(d, "id", "text", w, "item", "text").collect())
    assert got == Counter((i, j) for i, t in enumerate(items) for j, x in enumerate(docs) if t and x and t in x)
    assert sets.containing(d, "id", "text", w.limit(0), "item", "text").count() == 0


def test_owned_marks_release_their_claims(spark):
    # 1 is a stem, 2 sits over it, 3 sits over 2 (which is owned, so 3 is free), 4 sits over 3 and is owned by it.
    rows = [(0, 1, 0.0, 100.0, 4.0, 40.0), (0, 2, 0.0, 80.0, 4.0, 16.0), (0, 3, 0.0, 71.0, 4.0, 6.0), (0, 4, 0.0, 67.5, 4.0, 2.5), (0, 5, 300.0, 100.0, 4.0, 40.0), (1, 6, 0.0, 80.0, 4.0, 16.0)]
    got = {r["id"]: r["owner"] for r in marks.owned(spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double"), "page", 20.0).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}


def test_greedy_distinct_is_as_one_after_the_other(spark):
    rng = random.Random(4)
    rows = [(g, i, round(rng.random() * 6, 2), round(rng.random() * 6, 2)) for g in "ab" for i in range(150)]
    got = {(r["g"], r["o"]) for r in greedy.distinct_shapes(spark.createDataFrame(rows, "g string, o int, x double, y double"), "g", "o", ["x", "y"], 0.5).collect()}
    kept: list = []
    for r in sorted(rows):
        if not any(k[0] == r[0] and abs(k[2] - r[2]) <= 0.5 and abs(k[3] - r[3]) <= 0.5 for k in kept):
            kept.append(r)
    assert got == {k[:2] for k in kept}


def test_jobs_are_saved_run_and_deleted(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/jobs")
    assert store.all().count() == 0 and not store.delete("a")
    store.save(spark.createDataFrame([("a", '{"statement": "SELECT k FROM {t} WHERE k > :least", "parameters": {"least": null}}'), ("b", "damaged {")], "name string, document string"))
    assert [r["name"] for r in store.all().collect()] == ["a"]
    job, t = store.load("a"), spark.range(5).withColumnRenamed("id", "k")
    assert run_job(spark, job, {"t": t}, least=2).count() == 2
    for given in ({}, {"least": 1, "other": 2}):
        with pytest.raises(ValueError):
            run_job(spark, job, {"t": t}, **given)
    with pytest.raises(NoSuchName, match="there is a"):
        store.load("c")
    with pytest.raises(ValueError):
        store.save(spark.createDataFrame([("no name", "{}")], "name string, document string"))
    assert store.delete("a") and store.all().count() == 0
    assert spark.read.parquet(f"{tmp_path}/jobs").filter(F.col("deleted")).count() == 1


@pytest.mark.parametrize("most", [100_000, 5])
def test_elements_among_infinities_and_the_widest_range(spark, monkeypatch, most):
    monkeypatch.setattr(fits, "MOST", most)
    monkeypatch.setattr(fits, "BINS", 16)
    inf, nan, big, least = float("inf"), float("nan"), 1.7976931348623157e308, 5e-324
    rng = random.Random(7)
    normal = [rng.gauss(0, 1) for _ in range(40)]
    groups = {
        "inf": [*range(12), inf], "both": [-inf, -inf, *normal, inf, inf, inf], "nan": [*normal, nan, nan], "wide": [-1.7e308, 1.7e308, *normal, big, -big], "tiny": [least * i for i in range(30)],
        "far": [*normal, 1e300, -1e300], "all": [inf] * 9, "odd": [nan] * 7 + [-inf] * 7, "close": [1.0 + i * 2.220446049250313e-16 for i in range(50)], "signs": [-0.0, 0.0, least, -least, *[10.0**e for e in range(-300, 300, 20)]],
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double").repartition(3)
    got = {r["g"]: r for r in fits.elements(df, ["g"], "x", {**{f"e{i}": F.lit(i) for i in (0, 1, 7, 12)}, "middle": fits.part_of(1, 2), "last": F.col("n") - 1, "beyond": F.col("n"), "none": F.lit(-1)}).collect()}
    for g, xs in groups.items():
        v = sorted(map(float, xs), key=lambda x: (x != x, x))
        for name, i in {"e0": 0, "e1": 1, "e7": 7, "e12": 12, "middle": len(v) // 2, "last": len(v) - 1, "beyond": len(v), "none": -1}.items():
            want = v[i] if 0 <= i < len(v) else None
            assert got[g][name] == want or (want != want and got[g][name] != got[g][name]), (g, name)
    whole = spark.createDataFrame([(1, x) for x in [-(2**63), 2**63 - 1, 5, 6, 7, 2**53 + 1, 2**53, 2**53 + 2, 2**62, None]], "g int, x long")
    row = fits.elements(whole, ["g"], "x", {f"e{i}": F.lit(i) for i in range(9)}).first()
    assert [row[f"e{i}"] for i in range(9)] == [-(2**63), 5, 6, 7, 2**53, 2**53 + 1, 2**53 + 2, 2**62, 2**63 - 1]


def test_tables_go_when_their_run_ends(spark):
    folder = f"{tables.shared_folder(spark)}/tables"
    held = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    tables.written(edges, "first")
    sizes, before = [], held()
    for _ in range(3):
        with tables.Temporary(spark):
            with tables.Temporary(spark) as inner:
                kept = inner.keep(tables.written(components.components(edges), "kept"))
            assert kept.count() == 61 and len(held() - before) == 1
        sizes.append(held() - before)
    assert sizes == [set(), set(), set()]


def hot(spark):
    """A third of all rows in one group."""
    rng = random.Random(11)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, *map(str, range(200))]), i, rng.random() < 0.6, rng.randrange(50), float(rng.randrange(5000))) for i in range(6_000)]
    return rows, spark.createDataFrame(rows, "g string, i int, flag boolean, size int, v double").repartition(6)


def test_scans_split_a_hot_group(spark):
    rows, df = hot(spark)
    dealt = scan.dealt(df, ["g"], ["i"])
    parts = dealt.groupBy("__part").count().collect()
    assert max(p["count"] for p in parts) < 2 * len(rows) / len(parts) and len(parts) == 4
    assert dealt.filter("g = 'hot'").select("__part").distinct().count() > 1
    got = scan.before(dealt, ["g"], total=("sum", F.col("size")), most=("max", F.col("v")), flagged=("last", F.when(F.col("flag"), F.col("i"))))
    held = {}
    for g, i, flag, size, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        held[i] = (held.get(("sum", g), 0), held.get(("max", g)), held.get(("last", g)))
        held["sum", g] = held.get(("sum", g), 0) + size
        held["max", g] = max(v, held.get(("max", g), v))
        if flag:
            held["last", g] = i
    assert all((r["total"], r["most"], r["flagged"]) == held[r["i"]] for r in got.collect())


def test_islands_of_a_hot_group(spark):
    rows, df = hot(spark)
    rows = [r for r in rows if r[0] is not None]
    df = df.filter("g IS NOT NULL")
    groups = {g: sorted(r[1:] for r in rows if r[0] == g) for g in {r[0] for r in rows}}
    bands, offsets, at, numbers = set(), {}, {}, {}
    for g, mine in groups.items():
        runs = [[(f, [r for _, r in part]) for f, part in itertools.groupby(((r[1], r) for r in mine), key=lambda x: x[0])]]
        bands |= {(g, f, part[0][0], part[-1][0], len(part)) for f, part in runs[0]}
        total, counters = 1, [0, 0, 0]
        for k, (i, _, size, v) in enumerate(mine):
            offsets[i] = total
            total += size
            if g not in at and k + 1 < len(mine) and v > mine[k + 1][3]:
                at[g] = i
            level = size % 3 + 1
            counters = [*counters[: level - 1], counters[level - 1] + 1, *[0] * (3 - level)]
            numbers[i] = ".".join(map(str, counters[:level]))
    assert {tuple(r) for r in islands.bands(df, ["g"], "i", "flag").select("g", "flag", "first", "last", "n").collect()} == bands
    assert {r["i"]: r["starts"] for r in islands.offsets(df, ["g"], "i", "size").collect()} == offsets
    assert {r["g"]: r["at"] for r in islands.inversions(df, ["g"], "i", F.col("v")).collect()} == at
    levels = df.withColumn("lv", F.col("size") % 3 + 1)
    assert {r["i"]: r["numbers"] for r in islands.hierarchical_numbers(levels, "g", "i", "lv", 3).collect()} == numbers
    spans = df.select("g", "i", (F.col("v") * 10).alias("l"), (F.col("v") * 10 + F.col("size")).alias("r"), F.col("size").cast("double").alias("h"))
    limit = {r["g"]: r["gap_limit"] for r in islands.data_limits(spans, ["g"], "l", "r", "h").collect()}
    sessions = {r["i"]: r["session"] for r in islands.own_sessions(spans, ["g"], "l", "r", "h").collect()}
    for g, mine in groups.items():
        reached, n, gaps, starts = None, 0, [], []
        for left, right, i in sorted((v * 10, v * 10 + size, i) for i, _, size, v in mine):
            gaps += [] if reached is None else [left - reached]
            starts.append((i, None if reached is None else left - reached, left, right))
            reached = right if reached is None else max(reached, right)
        heights = sorted(float(r[2]) for r in mine)
        want = 0.3 if len(gaps) < 4 else max(2.2 * sorted(gaps)[len(gaps) // 2], 0.45 * heights[len(heights) // 4], 0.3)
        assert abs(limit[g] - want) < 1e-9
        seen: dict = {}
        for i, gap, left, right in starts:
            n += gap is None or gap > want
            seen.setdefault((left, right), []).append((i, n))
        for tied in seen.values():  # rows with the same ends are in any order
            assert sorted(sessions[i] for i, _ in tied) == sorted(n for _, n in tied)


def test_nothing_gives_nothing_and_ends(spark):
    none = spark.createDataFrame([], "g string, x double, y double, o int, n string")
    one = spark.createDataFrame([("a", 1.0, 2.0, 1, "n")], none.schema)
    for empty in (none, one.limit(0), one.filter("1 = 0")):
        assert fits.indexed_quantiles(empty, ["g"], "x").count() == 0 and fits.robust_line(empty, ["g"], "x", "y").count() == 0
        assert islands.own_sessions(empty, ["g"], "x", "y", "x").count() == 0 and islands.bands(empty.withColumn("f", F.lit(True)), ["g"], "o", "f").count() == 0
    assert [tables.written(spark.range(n), "x", F.col("id") > 3).any for n in (5, 4, 0)] == [True, False, False]
