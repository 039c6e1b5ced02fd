"""Source divergence against a plain count on small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n string"


def by_hand(rows, least, top):
    docs, own = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(terms))
        own[lang or "", source or ""].update(terms)
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    share, out = {}, set()
    for (lang, source), c in own.items():
        total = sum(c[t] for t in kept[lang])
        share[lang, source] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}
    for (lang, source), p in share.items():
        all_counts = Counter({t: sum(c[t] for (x, _), c in own.items() if x == lang) for t in kept[lang]})
        total = sum(all_counts.values())
        pairs = [(s, sum(abs(p[t] - q[t]) for t in p)) for (x, s), q in share.items() if x == lang and s != source]
        q = {t: 1 + 10**9 * (all_counts[t] + 5) // (total + 5 * len(p)) for t in p}
        terms = [(t, p[t] - q[t]) for t in p if own[lang, source][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def sample(n=500, sources=9):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(300)] + ["Über", "straße", "日本語", "naïve"]
    rows = []
    for i in range(n):
        source = int(min(rng.integers(0, sources * 2), sources - 1)) if i % 3 else 0  # one source has most rows
        words = [vocabulary[int(min(rng.exponential(30 + 5 * source), 303))] for _ in range(40)]
        rows.append((i, " ".join(words) + (" a1b-c\n" if i % 2 else ""), "de" if i % 4 == 0 else "en", f"s{source}", "own"))
    return rows


ODD = [(1, None, None, None, None), (2, "", "en", "empty", None), (3, "123 -- !", "en", None, None), (4, "Word " * 2000, "fr", "x", None), (4, "Word " * 2000, "fr", "x", None), (5, "lonely", "xx", "only", None)]


@pytest.mark.parametrize("least, top, block, tile", [(1, 50, 4096, 64), (5, 3, 16, 2), (30, 50, 7, 3), (10**6, 50, 8, 4)])
def test_against_plain_counts(spark, monkeypatch, least, top, block, tile):
    rows = sample() + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(divergence, "TILE", tile)
    out = divergence.audit(df, least, top, block)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, least, top)


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows = sample(120, 4)
    batch = spark.createDataFrame(rows, SCHEMA).select("lang", "source", "text").toArrow().to_batches()
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 1000)
    total = Counter()
    for b in divergence._counted(iter(batch)):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    wanted = Counter((lang, source, t) for _, text, lang, source, _ in rows for t in TERM.findall(text.translate(LOWER)))
    assert total == wanted


def test_difference_of_runs():
    a, b = np.array([5, 5, 5, 1, 1, 9, 9, 9]), np.array([2, 2, 7, 7, 7, 7, 7, 0])
    runs = [(np.flatnonzero(np.diff(x, prepend=-1)), x[np.flatnonzero(np.diff(x, prepend=-1))]) for x in (a, b)]
    assert divergence.difference(*runs, 8) == int(np.abs(a - b).sum())


def test_large_counts_stay_exact(spark):
    n = 10**12
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p"), divergence._share(F.lit(3), F.lit(10), F.lit(2)).alias("q")).head()
    assert row["p"] == 1 + 10**9 * (n + 5) // (3 * n + 35) and row["q"] == 1 + 10**9 * 8 // 20


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
