import random
from itertools import combinations

import pytest

from plumbline.llm import near_copies
from plumbline.llm.components import components

KIND = "doc_id long, text string, component string, node int"


def near_classes(texts):
    """Sets of keys of texts (key: text) joined by Jaccard similarities of 0.8 or more over sets of five-word shingles, by brute force."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
            root[top(a)] = top(b)
    found = {}
    for k in sets:
        found.setdefault(top(k), set()).add(k)
    return list(found.values())


def classes(spark, rows):
    own = near_copies.with_classes(spark.createDataFrame(rows, KIND))
    found = {}
    for r in own.collect():
        found.setdefault(bytes(r.component), []).append(r.doc_id)
    return sorted(map(sorted, found.values()))


def words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(100_000)}"
    return out


def test_classes_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):  # near copies about the threshold
        base = words(rng, 300)
        texts += [" ".join(t) for t in (base, edited(rng, base, 3), edited(rng, base, 7), edited(rng, base, 12))]
    for _ in range(4):  # chains: neighbours are near, the ends are not
        text = words(rng, 400)
        for _ in range(12):
            texts.append(" ".join(text))
            text = edited(rng, text, 6)
    base = words(rng, 200)
    texts += [" ".join(edited(rng, base, rng.choice([1, 2, 4, 9]))) for _ in range(150)]  # one large bucket, partly near
    texts += [" ".join(words(rng, n)) for n in (1, 2, 4, 5, 6, 30_000)]
    rows = [(k, t, "c", 1) for k, t in enumerate(texts)]
    expected = sorted(sorted(c) for c in near_classes(dict(enumerate(texts))))
    assert any(len(c) > 5 for c in expected) and sum(len(c) == 1 for c in expected) > 5
    assert classes(spark, rows) == expected


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_documents(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = [(r.doc_id, r.text, None, None) for r in docs.collect()]
    assert classes(spark, rows) == sorted(sorted(c) for c in near_classes({r[0]: r[1] for r in rows}))


def test_nulls_empty_repeated_and_clashing(spark):
    rows = [(1, None, None, None), (2, "", "c", 1), (3, " \n", "c", 2), (4, "Two words", "c", 3), (5, "two\twords", "c", 4), (5, "two\twords", "c", 4), (None, "alone", "c", 5), (6, "two words more", "c", 6)]
    docs = spark.createDataFrame(rows, KIND)
    assert near_copies.with_classes(docs).count() == len(rows)
    left = near_copies.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "alone"), (1, None), (4, "Two words"), (6, "two words more")]
    empty = near_copies.deduplicated(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def counted(monkeypatch):
    """A list that takes the number of pairs of each call that compares such."""
    found, near = [], near_copies._near
    monkeypatch.setattr(near_copies, "_near", lambda pairs, sets: found.append(pairs.count()) or near(pairs, sets))
    return found


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    rng = random.Random(5)
    base, pairs = words(rng, 150), counted(monkeypatch)
    texts = [" ".join(edited(rng, base, rng.choice([2, 5, 7, 9]))) for _ in range(700)]  # most are alike and not near
    expected = sorted(sorted(c) for c in near_classes(dict(enumerate(texts))))
    assert len(expected) > 200 and max(map(len, expected)) > 100
    assert classes(spark, [(k, t, "c", 1) for k, t in enumerate(texts)]) == expected
    assert sum(pairs) <= 3 * len(texts)


def test_families_apart_from_the_pivot(spark, monkeypatch):
    rng = random.Random(6)
    base, texts, pairs = words(rng, 200), [], counted(monkeypatch)
    for _ in range(8):  # the copies of one family share edits and are near each other, those of two families aren't
        family = edited(rng, base, 8)
        texts += [" ".join(edited(rng, family, rng.choice([1, 1, 2, 6]))) for _ in range(60)]
    expected = sorted(sorted(c) for c in near_classes(dict(enumerate(texts))))
    assert sum(len(c) > 20 for c in expected) == 8
    assert classes(spark, [(k, t, "c", 1) for k, t in enumerate(texts)]) == expected
    assert sum(pairs) <= 60 * len(texts)


def test_texts_meet_by_simhash(spark):
    rng = random.Random(7)
    base = words(rng, 4000)
    texts = [base, edited(rng, base, 3), edited(rng, base, 3), words(rng, 4000)]
    docs = spark.createDataFrame([(k, " ".join(t), "c", 1) for k, t in enumerate(texts)], KIND)
    own = near_copies.signatures(docs)
    found = near_copies.links(docs, own.selectExpr("node", "fp", "array(doc_id) AS keys")).collect()  # no two meet by min-hashes
    ids = {bytes(r.node): r.doc_id for r in own.collect()}
    linked = {frozenset((ids[bytes(r.u)], ids[bytes(r.v)])) for r in found}
    assert set().union(*linked) == {0, 1, 2} and len(linked) >= 2


def test_components_in_one_task(spark):
    rng = random.Random(8)
    edges = [(f"{rng.randrange(300):03}".encode(), f"{rng.randrange(300):03}".encode()) for _ in range(170)] + [(None, b"1"), (b"7", b"7")]
    for rows in (edges, []):
        table = spark.createDataFrame(rows, "u binary, v binary")
        found = [sorted((bytes(r.node), bytes(r.component)) for r in components(table, small=n).collect()) for n in (0, 1000)]
        assert found[0] == found[1] and bool(found[0]) == bool(rows)
