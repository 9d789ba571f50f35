import random

import numpy as np
import pytest

from plumbline.llm import queries, token_counts


@pytest.fixture(scope="module")
def encoding():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.encoder(f.read())


def plain(encoding, text):
    """Tokens of each line by walking over the decoded tokens one after another."""
    e, _ = encoding
    data = text.encode()
    starts = [0, *(k + 1 for k, c in enumerate(data) if c == 10 and k + 1 < len(data))] if data else []
    counts, at = [0] * len(starts), 0
    for token in e.encode_ordinary(text):
        counts[max(k for k, s in enumerate(starts) if s <= at)] += 1
        at += len(e.decode_single_token_bytes(token))
    assert at == len(data)
    return counts


def test_against_walk(spark, encoding):
    r = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "a\n", " \n \n x", "<|endoftext|>\nnext", "é 日本\n\U0001f600 x\r\n y"]
    texts += ["".join(r.choices(["word", "s", " ", "  ", "\n", "\n\n", "é", "12", ".", "'ll", "日"], k=r.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a b", 2)], "doc_id long, text string, n_tokens int")
    got = {x.doc_id: x for x in token_counts.counted(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k].section_tokens == plain(encoding, t or "") and got[k].n_tokens == sum(got[k].section_tokens)
    assert got[None].n_tokens == 2 and token_counts.counted(docs.limit(0)).count() == 0


def test_long_texts_are_cut_where_tokens_end(encoding):
    e, _ = encoding
    text = " ".join(["words", "of", "1", "text,", "é", "x\n\ny"] * 200)
    cut = list(token_counts.pieces(text, 50))
    assert "".join(cut) == text and len(cut) > 20
    assert [t for p in cut for t in e.encode_ordinary(p)] == e.encode_ordinary(text)
    assert list(token_counts.pieces("1 " * 100, 50)) == ["1 " * 100]


def test_crossing_rule():
    assert token_counts.attributed(np.array([3, 6, 9]), np.array([0, 4, 8])).tolist() == [2, 1, 0]
    assert token_counts.attributed(np.array([], int), np.array([], int)).tolist() == []


def test_query_sums(spark):
    for r in queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert sum(map(int, filter(None, r.section_tokens.split(",")))) == r.n_tokens
