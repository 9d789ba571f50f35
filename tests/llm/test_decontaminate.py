import random
import re

import pytest

from plumbline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, t in items:
        v = plain_words(t)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    r = random.Random(block_bytes)
    vocabulary = ["a", "B", "été", "x1", "the", "of", "Ünder", "z9", "q", "日本"]
    item = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, item(r.choice([13, 14, 20, 40]))) for i in range(25)] + [(90, "a B, été"), (91, ""), (92, None), (93, "..."), (100, "x1 x1"), (25, "the " * 30), (25, "of " * 13)]
    docs = [(0, None, 1), (1, "", 1), (2, "a-b/été", 2), (2, "a-b/été", 2), (None, "X1\x1fx1", 3)]
    for i in range(60):
        text = item(r.randint(0, 60))
        for _, t in r.sample(items[:25], r.randint(0, 2)):
            w = t.split()
            at = r.randint(0, max(0, len(w) - 12))
            text += " ; ".join(["", *w[at : at + r.randint(10, 30)], ""]).upper().replace("É", "é").replace("Ü", "ü") + item(r.randint(0, 20))
        docs.append((10 + i, text, i))
    got = decontaminate.scanned(spark.createDataFrame(docs, "doc_id long, text string, hit int"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(x.row.doc_id, x.n_words, x.n_hit, x["items"]) for x in got], key=key) == sorted([(i, *plain(t, items)) for i, t, _ in docs], key=key)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit, x["items"]) for x in decontaminate.scanned(docs, none, keep=["doc_id"]).collect()] == [(2, 0, [])]
    assert decontaminate.scanned(docs.limit(0), none).count() == 0
