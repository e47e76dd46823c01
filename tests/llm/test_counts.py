"""Token counts against the library's own over whole texts, with chunks so small that all is spliced."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import counts, queries

PATH = queries.vocabulary("word_bpe_49k.json")


def texts():
    rng = random.Random(6)
    letters = list("aabcdeĭé  \n\t''''llstdrvem.,;!<|>endoftext0129漢字かがहिन्दीกำ각각İßǅΣς🙂🙂̣́̀ᅡᆨ \x85\x1c ")
    pieces = ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "é", "ㄱ", "각", "ạ́", "<|endof", "word ", "Ünï ", "12 "]
    out = ["".join(rng.choice([*letters, *pieces]) for _ in range(rng.randrange(200, 1500))) for _ in range(40)]
    out += ["x" * 5_000, "ab " * 2_000, "x" * 900 + " end " + "y" * 2_300, "漢字" * 900, "<|endoftext|>" * 300, "'ll" * 700, "é" * 1_000, "a" + "́" * 2_000, "!" * 3_000, "1" * 2_000, " " * 4_000, "각" * 700, "가" * 500, "🙂" * 800, "wörter und Wörter, " * 150]
    return [None, "", " ", "a", *out]


def test_counts_are_the_librarys(spark):
    library = counts.library(PATH)
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts())] + [(3, "again " * 400, "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(5)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids), s) for i, t, s in rows)
    for chunk, overlap in ((200, 60), (333, 150), (1 << 16, 1 << 10)):
        got = counts.token_counts(df, lambda: PATH, 100, chunk=chunk, overlap=overlap)
        assert got.columns == ["doc_id", "text", "size", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["size"]) for r in got.collect()) == want
        assert got.filter(F.col("over_limit") != (F.col("n_tokens") > 100)).count() == 0
    assert counts.token_counts(df.limit(0), PATH, 5).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_chunks_meet_only_where_the_whole_text_has_a_word(seed):
    """Every place that neighbours share is one where the whole text begins a word, with as many tokens between."""
    coder, rng = counts.Chunks(PATH), random.Random(seed)
    for text in rng.sample([t for t in texts() if t and len(t) > 150], 25):
        raw = text.encode()
        size, chunk, overlap = len(raw), rng.randrange(150, 400), rng.randrange(80, 140)
        n, _, _, places, tokens = coder.count(raw, 0, 0, 0, size)
        whole = dict(zip(places, tokens, strict=True))
        starts = list(range(0, size, chunk))
        cut = [coder.count(raw[s : s + chunk + overlap], s, min(s + chunk, size), overlap, size) for s in starts]
        for left, right in zip(cut, cut[1:], strict=False):
            for place in set(left[3]) & set(right[1]):
                assert place in whole or place > size - counts.MARGIN
        met = [min(set(a[3]) & set(b[1]), default=None) for a, b in zip(cut, cut[1:], strict=False)]
        if None not in met:
            total = cut[-1][0] + sum(dict(zip(a[3], a[4], strict=True))[m] - dict(zip(b[1], b[2], strict=True))[m] for a, b, m in zip(cut, cut[1:], met, strict=False))
            assert total == n
