import random
import re
from collections import Counter
from math import comb

import pytest

from plumbline.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    r = random.Random(8)
    texts = [None, "", "  \n ", "a", "a b", "a b a", "a a a a", "é#\x0b<日本>\x1c x\n\n é#\x0b<日本>\x1c x \né#\x0b<日本>\x1c x"]
    texts += ["".join(r.choice(["a", "b", "ç*", "|"]) + r.choice(" \n\t") for _ in range(r.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b", "y")], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r[c] for c in quality_rules.MEASURES) for r in quality_rules.measured(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)} | {None: plain("a b")}


def test_binomial():
    for n, p in ((1, 0.3), (17, 0.2), (60, 0.01), (200, 0.5)):
        for k in range(-1, n + 2):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
            assert quality_rules.binomial_at_most(k, n, p) == pytest.approx(want, abs=1e-10)
    assert quality_rules.binomial_at_most(0, 10**7, 1e-6) == pytest.approx(0.0000453999, rel=1e-3)


def test_order_and_walk():
    above = {("a", 2.0): (0, 5), ("a", 1.0): (0, 9), ("b", 1.0): (1, 90), ("c", 1.0): (50, 50), ("d", 1.0): (0, 0)}
    assert quality_rules.ordered(1000, 100, above) == [("b", 1.0), ("a", 1.0), ("a", 2.0)]  # c's lift is too low, d catches none
    walk = lambda good, counts, risk=0.01: quality_rules.admitted(good, 50, counts, risk, 0.0125)
    assert walk(100, [(0, 10)]) == 0  # too few labels
    assert walk(1000, [(0, 10), (1, 20), (90, 20)]) == 2  # the third union is too much
    assert walk(1000, [(0, 40), (0, 0), (1, 0)]) == 1  # the later ones catch nothing more
    assert walk(1000, [(90, 50), (0, 0)]) == 0  # the walk stops at once
    assert walk(1000, [(3, 20), (3, 20)]) == 1  # each alone is fine, both together aren't


def test_union_of_rules_keeps_the_risk():
    """Over many holdouts from a population of which each step rejects some good texts, the union chosen seldom exceeds the risk."""
    r, risk, level, exceeded, used = random.Random(5), 0.02, 0.05, 0, 0
    for _ in range(400):
        true = [r.choice([0.0, 0.002, 0.006, 0.01]) for _ in range(6)]
        n, counts = 600, [0] * 7
        for _ in range(n):
            x, k = r.random(), 0
            while k < 6 and x >= true[k]:
                x, k = x - true[k], k + 1
            counts[k] += 1
        k = quality_rules.admitted(n, 100, [(c, 10) for c in counts[:6]], risk, level)
        used += k > 0
        exceeded += sum(true[:k]) > risk
    assert used > 300 and exceeded <= 0.05 * 400


def test_cutoffs_against_plain_counts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    docs = [(k, " ".join(word() + ("!" * r.randint(0, 2) if k % 3 == 0 else "") + ("#" if k % 7 == 0 and r.random() < 0.3 else "") for _ in range(r.choice([60, 250])))) for k in range(900)]
    docs += [(5000 + k, docs[k][1]) for k in range(200)]  # copies
    labels = [(k, int(k % 3 > 0)) for k, _ in docs if k < 5000] + [(5000, None), (5001, 7)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    measures = quality_rules.measured(docs)
    got = quality_rules.cutoffs(measures, labels, risk=0.05)
    good = {x.doc_id: x.quality for x in labels.collect()}
    once = {x.text_hash: x for x in sorted(measures.collect(), key=lambda x: -x.doc_id) if good.get(x.doc_id) in (0, 1)}
    fold = {x.text_hash: x.f for x in measures.selectExpr("text_hash", "pmod(xxhash64(text_hash), 4) f").collect()}
    names = {"symbols": lambda x: x.n_symbols / x.n_words, "marks": lambda x: x.n_marks / x.n_words, "capitals": lambda x: x.n_capitals / x.word_chars, "repeats": lambda x: x.n_repeat_words / x.n_words, "dup_lines": lambda x: x.n_dup_lines / x.n_lines, "long_words": lambda x: x.word_chars / x.n_words, "short_words": lambda x: -x.word_chars / x.n_words}
    want = {}
    for s, (low, high) in enumerate(((0, 200), (200, 600))):
        part = {f: {g: [x for x in once.values() if low <= x.n_words < high and (fold[x.text_hash] > 0) == f and good[x.doc_id] == g] for g in (0, 1)} for f in (False, True)}
        steps = [(name, c) for name, (_, cs) in quality_rules.rules().items() for c in cs]
        above = {step: tuple(sum(names[step[0]](x) > step[1] for x in part[False][g]) for g in (1, 0)) for step in steps}
        order = quality_rules.ordered(len(part[False][1]), len(part[False][0]), above)
        first = {g: Counter(next((k for k, (n, c) in enumerate(order) if names[n](x) > c), None) for x in part[True][g]) for g in (0, 1)}
        n = quality_rules.admitted(len(part[True][1]), len(part[True][0]), [(first[1][k], first[0][k]) for k in range(len(order))], 0.05, 0.05 / 4)
        for name, c in order[:n]:
            want.setdefault(s, {})[name] = min(c, want.get(s, {}).get(name, c))
    assert got == want and got


def test_judged(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    docs = [(k, " ".join(word() + ("***" if k % 10 == 0 else "") for _ in range(80))) for k in range(3000)] + [(3000, "too few"), (3001, "x y z " * 60), (3002, None)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(3000)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_rules.judged(docs, labels, risk=0.01).collect()}
    assert [x.base_failed for k, x in sorted(got.items()) if k >= 3000] == [True] * 3 and not any(got[k].kept for k in (3000, 3001, 3002))
    assert not any(got[k].kept for k in range(0, 3000, 10)) and sum(got[k].kept for k in range(3000)) >= 2700 * 0.99
    unlabelled = quality_rules.judged(docs, labels.limit(0)).collect()
    assert sum(x.kept for x in unlabelled) == 3000
    assert quality_rules.judged(docs.limit(0), labels).count() == 0


def test_repeated_and_very_long_rows(spark):
    long = "word " * 400_000 + "end"
    rows = [(1, "a b c " * 30, "x"), (1, "a b c " * 30, "y"), (2, long, "z")]
    got = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_repeat_words) for x in got) == [(1, 90, 90), (1, 90, 90), (2, 400_001, 400_000)]
