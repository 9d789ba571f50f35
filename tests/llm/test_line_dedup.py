import random
from collections import Counter, defaultdict

import pytest

from plumbline.llm import line_dedup
from plumbline.llm.text import SPACE


def words(line):
    return [w for w in "".join("\x00" if ord(c) < 128 and SPACE[ord(c)] else c for c in line).split("\x00") if w]


def masked(line):
    return tuple(None if any(c in "0123456789@/=" for c in w) else w for w in words(line))


def plain(texts, contexts, depth=2):
    """(n_lines, n_dropped, text left) of each text, by dictionaries."""
    of = [{m for x in (text or "").split("\n") if (m := masked(x))} for text in texts]
    holders = defaultdict(set)
    for lines in of:
        for m in lines:
            holders[m].add(frozenset(lines))
    count = Counter()
    path = lambda m: (len(m), m[:depth])
    for m, docs in holders.items():
        for at, w in enumerate(m):
            count[path(m), at, w] += len(docs)
    templates = {}
    for m in holders:
        templates[m] = tuple(w if at < depth or w is not None and count[path(m), at, w] >= contexts else None for at, w in enumerate(m))
    support = defaultdict(set)
    for m, docs in holders.items():
        support[templates[m]] |= docs
    known = lambda t: sum(w is not None for w in t)
    bad = {m for m, t in templates.items() if len(m) >= 3 and known(t) >= 3 and 2 * known(t) >= len(t) and len(support[t]) >= contexts}
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        gone = {k for k, x in enumerate(lines) if masked(x) in bad}
        left = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((sum(1 for x in lines if words(x)), len(gone), left))
    return out


@pytest.mark.parametrize("block", [1000, 0])
def test_against_brute_force(spark, block):
    r = random.Random(4)
    prose = lambda: " ".join(r.choices(["ab", "cd", "été", "gh", "ij", "Kl", "mn."], k=r.randint(1, 9)))
    notice = lambda: r.choice([f"page {r.randint(1, 99)} of the book", "All rights reserved here", f"Posted by {r.choice('abcdefghijklmnop')}nn at 9:{r.randint(10, 59)} today", "a b", f"{r.randint(1, 9)} 7 x"])
    texts = [None, "", "\n\n", "All rights reserved here", " ".join(["long"] * 50_000) + "\nAll rights reserved here"]
    for _ in range(60):
        texts.append("\n".join(notice() if r.random() < 0.3 else "" if r.random() < 0.1 else prose() for _ in range(r.randint(1, 8))))
    texts += [texts[10]] * 30 + ["one line in all copies\nand another line of them"] * 40
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    got = sorted(line_dedup.cleaned(docs, ["doc_id", "n_lines"], contexts=5, block=block).collect(), key=lambda x: x.row.doc_id)
    want = plain(texts, 5)
    assert [(x.n_lines, x.n_dropped, x.text) for x in got] == want
    assert sum(n for _, n, _ in want) > 20 and {x.row.n_lines for x in got} == {"x"}
    assert any("nn at" in (t or "") and "nn at" not in left for t, (_, _, left) in zip(texts, want, strict=True) if left is not None)


def test_plain_words_that_vary_are_generalised(spark):
    """A field of lower-case words, each of them rare, in a line that is else constant."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    texts = [f"{word()} {word()} {word()} {word()}\nwritten by {word()} for the weekly" for _ in range(40)]
    got = line_dedup.cleaned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert {x.n_dropped for x in got} == {1} and all(x.text == texts[x.row.doc_id].split("\n")[0] for x in got)


def test_copies_are_no_recurrence_and_empty(spark):
    docs = spark.createDataFrame([(1, "the first line of it\nthe second line of it") for k in range(50)], "doc_id long, text string")
    assert {x.n_dropped for x in line_dedup.cleaned(docs, ["doc_id"], with_text=False).collect()} == {0}
    assert line_dedup.cleaned(docs.limit(0), ["doc_id"]).count() == 0


def test_boilerplate_goes_despite_copies_and_companions(spark):
    names = [chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(300)]
    own = lambda k: f"own {names[k]} words of {names[k]} {names[k]} {names[k]}"
    noted = [f"{own(k)}\nread our notice on privacy" for k in range(30)]
    copies = ["a story that has copies\nread our notice on privacy\nand its second line"] * 400
    pages = ["\n".join([own(k)] + [f"menu line about {n}" for n in names[:20]]) for k in range(30, 230)]
    docs = spark.createDataFrame(list(enumerate(noted + copies + pages)), "doc_id long, text string").repartition(8)
    got = {r.row.doc_id: r.text for r in line_dedup.cleaned(docs, ["doc_id"]).collect()}
    left = [own(k) for k in range(30)] + ["a story that has copies\nand its second line"] * 400 + [own(k) for k in range(30, 230)]
    assert [got[k] for k in range(len(left))] == left
