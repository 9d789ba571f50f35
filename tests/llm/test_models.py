import math
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import language_id, quality_model, queries
from plumbline.llm.text import SLICE_BYTES


def plain_bits(train, text, order=3):
    """Code length of a text by dictionaries of contexts, one byte after another."""
    tree = {}
    for t in train:
        data = b"\n\n\n" + t.encode().lower()
        for i in range(3, len(data)):
            for k in range(order + 1):
                tree.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                tree[data[i - k : i]][data[i]] += 1
    data, bits = b"\n\n\n" + text.lower(), 0.0
    for i in range(3, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = tree.get(data[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_are_exact():
    r = random.Random(2)
    train = {k: ["".join(r.choices(a, k=r.randint(1, 200))) for _ in range(6)] for k, a in (("x", "abc dé\n"), ("y", "abz Ü.ß"))}
    model = language_id.trained([(k, t) for k, ts in train.items() for t in ts])
    texts = [b"", b"a", "ab\nÜ q日本".encode(), *("".join(r.choices("abcdzéÜ .\n", k=r.randint(1, 60))).encode() for _ in range(20))]
    got = language_id.code_lengths(model, texts)
    want = [[plain_bits(train[k], t) for k in ("x", "y")] for t in texts]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-4)
    long = "".join(r.choices("abcdz", k=SLICE_BYTES + 1000)).encode()
    assert np.allclose(language_id.code_lengths(model, [long, b"ab"])[0], [plain_bits(train[k], long) for k in ("x", "y")], rtol=1e-4)


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_language_query(spark):
    docs = {r.doc_id: r for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = queries.op8_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(r.held_out == held_out(r.doc_id, 3, 1) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) >= 0.95 * len(test)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0), (None, "12 34 !", "en", 0), (2, "the cat", "en", 0), (2, "the cat", "en", 0), (3, "le chat", None, 1)], "doc_id long, text string, lang string, score int")
    got = language_id.identified(docs, language_id.learned(docs)).collect()
    assert sorted((r.row.text or "", r.lang_pred) for r in got) == [("", "und"), ("12 34 !", "und"), ("le chat", "en"), ("the cat", "en"), ("the cat", "en")]
    none = docs.limit(0)
    assert language_id.identified(none, language_id.learned(none), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs, None).collect()} == {"und"}


def test_quality_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    got = queries.op3_quality_classifier(spark, folder).collect()
    assert len(got) == 1000 and all(r.held_out == held_out(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) >= 0.95 * len(test)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "fine words here", 5), (2, "fine words here", 5)], "doc_id long, text string, quality int")
    model = quality_model.learned(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality_model.scored(docs, model).collect()] == pytest.approx([0.5] * 4, abs=0.02)
    assert quality_model.scored(docs.limit(0), model).count() == 0
