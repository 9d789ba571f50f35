import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import mixing


def plain_targets(sizes, weights):
    total, caps, left = Fraction(3, 2) * sum(sizes), [Fraction(2 * s) for s in sizes], set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while left:
        w = sum(weights[i] for i in left)
        over = {i for i in left if total * weights[i] / w > caps[i]}
        if not over:
            for i in left:
                out[i] = total * weights[i] / w
            return out
        for i in over:
            out[i] = caps[i]
        total -= sum(caps[i] for i in over)
        left -= over
    return out


def test_targets_and_apportionment():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.randint(0, 5000) for _ in range(r.randint(1, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert mixing.targets(sizes, weights, 1.5, 2.0) == pytest.approx([float(x) for x in plain_targets(sizes, weights)])
        seats, plain = r.randint(0, 60), np.zeros(len(sizes), int)
        for _ in range(seats if sum(sizes) else 0):
            plain[max(range(len(sizes)), key=lambda i: (Fraction(sizes[i], 2 * int(plain[i]) + 1), -i))] += 1
        assert mixing.apportion(np.array(sizes), seats).sum() == plain.sum()
        quotient = lambda seated: sorted(Fraction(s, 2 * k + 1) for s, n in zip(sizes, seated.tolist(), strict=True) for k in range(n))
        assert quotient(mixing.apportion(np.array(sizes), seats)) == quotient(plain)


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 400)), r.choice(["a", "b", "b", "b", "b", "Z", None]), i) for i in range(400)]
    rows += [(7, "one two three", "a", 1)] * 2 + [(None, None, "é", 0), (900, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs, shard=2000).collect()
    assert len(got) == len(rows)
    sizes, by = defaultdict(int), defaultdict(int)
    for x in got:
        assert x.size == len((x.row.text or "").split()) and 0 <= x.taken <= 2 * x.size
        sizes[x.row.source] += x.size
        by[x.row.source] += x.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert order[-1] is None and order[0] == "Z"
    aims = plain_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
    for s, aim in zip(order, aims, strict=True):
        mine = [x for x in got if x.row.source == s]
        assert {x.source_size for x in mine} == {sizes[s]} and mine[0].target == pytest.approx(float(aim))
        assert abs(by[s] - aim) <= mixing.BLOCK * (2 + sizes[s] / 2000 / 2)
    again = mixing.mixed(docs.repartition(7), keep=["doc_id"], shard=2000).collect()
    assert sorted((x.row.doc_id or -1, x.size, x.taken) for x in got) == sorted((x.row.doc_id or -1, x.size, x.taken) for x in again)
    assert mixing.mixed(docs.limit(0)).count() == 0
