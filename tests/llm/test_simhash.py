import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.components import components
from plumbline.llm.text import xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéßñ", k=r.randint(1, 40 if r.random() < 0.05 else 7))) for _ in range(80)]
    out = [None, "", "  \n", "One", "one", "Two words", "a\x0bb\x1cc d e f"]
    while len(out) < n:
        if r.random() < 0.5 and len(out) > 8:
            words = (r.choice(out[7:])).split(" ")
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.randint(1, 120))))
    return out


def test_xxh64_of_ranges():
    import numpy as np

    data = bytes(range(256)) * 3
    buf = np.frombuffer(data + bytes(8), np.uint8)
    start, length = np.arange(150), np.arange(150) * 3 % 131
    assert xxh64(buf, start, length, 42).tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(start, length, strict=True)]


def test_against_brute_force(spark):
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts(1, 120))]
    got = {r.doc_id: (simhash_hex(r.fp), r.component_id) for r in simhash.with_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    label = plain_components(fps)
    assert got == {i: (f"{fp:016x}", label[i]) for i, fp in fps}


def simhash_hex(fp):
    return f"{fp % (1 << 64):016x}"


@pytest.mark.parametrize("bucket", [1, 3, 512])
def test_links_with_small_buckets(spark, bucket):
    r = random.Random(bucket)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r.node % (1 << 64): r.component for r in components(simhash.links(nodes, bucket)).collect()}
    label = plain_components([(x, x) for x in fps])
    groups = {}
    for x in fps:
        groups.setdefault(label[x], set()).add(x)
    found = {}
    for x in fps:
        found.setdefault(got.get(x, ("alone", x)), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_large_bucket_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        base = 0x0123456789ABCDEF
        fps = [base ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(a)] + [base ^ 1 ^ (0xFFF << 40)]
        nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
        got = {r.node: r.component for r in components(simhash.links(nodes, 4)).collect()}
        assert set(got) == set(fps[:-1]) and len(set(got.values())) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deduplicated_empty_and_repeated(spark):
    kind = "doc_id long, text string, lang string, _rank int"
    assert simhash.deduplicated(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "a b c d e", "en", 1), (1, "a b c d e", "en", 1), (2, "A b c d e", "de", 2), (3, None, "fr", 3), (None, "", "es", 4), (4, "other words in this one here", None, 5), (None, "no id but words of its own", "en", 6), (None, "no id but words of its own", "en", 6), (None, "some more without any id at all", "en", 7)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, kind).withColumn("more", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "_rank", "more"]
    assert sorted((r.doc_id or 0, r._rank) for r in kept.collect()) == [(0, 6), (0, 7), (1, 1), (3, 3), (4, 5)]


def test_each_component_keeps_a_row_where_ids_repeat(spark):
    near, apart = "a text that stands under two ids here", "%s words that no other row of all has"
    for k in range(4):
        rows = [(3, near), (5, near), (5, apart % f"k{k}"), (5, apart % f"k{k}")]
        kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, kept)) == [(3, near), (5, apart % f"k{k}")]
