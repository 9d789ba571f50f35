import hashlib
import random
import re

from plumbline.llm import shared, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """(doc_id, n_words, n_removed, sha256) by a table of all windows."""
    least, out = {}, []
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, key(i)), key(i))
    for i, text in rows:
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(11)
    word = lambda: r.choice("abcdefé") + r.choice(["", "x", "ÿ", "word-of-more-than-eight"])
    passages = [[word() for _ in range(r.randint(8, 60))] for _ in range(8)]
    rows = [(5, None), (6, ""), (None, " ".join(passages[0])), (7, "a " * 40), (8, "a " * 30), (3, "a\x1ca " + "b\n" * 25)]
    for i in range(90):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            w += p[a : a + r.randint(1, 60)] + [word() for _ in range(r.randint(0, 12))]
        rows.append((r.randint(10, 80), "\n".join(w)))
    rows += rows[20:30] + [(100 + k, rows[k][1]) for k in range(30, 40)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, id int")
    got = substrings.deduplicated(docs, window=10, anchor=4, with_text=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got], key=key) == sorted(plain(rows, 10), key=key)
    assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in got if x.n_removed)
    assert sum(x.n_removed for x in got) > 1000
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    """A passage in most documents, each with other words around it, copies, and one very long text."""
    monkeypatch.setattr(substrings, "BLOCK", 5)
    monkeypatch.setattr(shared.spread_join, "__defaults__", ("inner", 3, None))
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = [word() for _ in range(14)]
    rows = [(k, " ".join([word() for _ in range(r.randint(0, 9))] + passage[r.randint(0, 3) : r.randint(9, 14)] + [word() for _ in range(r.randint(0, 9))])) for k in range(60)]
    rows += [(100 + k, rows[7][1].replace(" ", " \t")) for k in range(20)] + [(200, " ".join([word() for _ in range(30_000)] + passage)), (201, " ".join(word() for _ in range(30_000)))]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), window=8, anchor=3).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted(plain(rows, 8))


def test_equal_runs_are_maximal():
    words = b"a b c d e f g h".split()
    assert list(substrings.equal_runs(words, b"b c x e f g h i".split(), 1, 2)) == [(1, 3), (4, 8)]
    assert list(substrings.equal_runs(words, b"x y".split(), 3, 1)) == [] and list(substrings.equal_runs(words, [], 3, 1)) == []
