import re
from collections import Counter

import corpus_pipeline
from test_near_copies import near_classes
from plumbline.llm import language_id, line_dedup, mixing, simhash

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs.limit(0), FOLDER).schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.95 * len(before)
        if name == "line_dedup":
            assert len(after) == len(before) and all(len(after[k].text) <= len(before[k].text) and after[k].n_chars == len(after[k].text) for k in after)
        if name == "simhash_near_dedup":
            classes = near_classes({k: r.text for k, r in before.items()})
            assert set(after) == {min(c) for c in classes} and len(after) < len(before)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 13]) for _, t in items if (w := plain_words(t)) for i in range(max(1, len(w) - 12))}
            for k, r in before.items():
                w = plain_words(r.text)
                held = any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
                assert (k in after) == (not held)
        if name == "source_mixing":
            assert all(0 < r.taken <= 2 * r["size"] for r in after.values())
            by = Counter()
            for r in after.values():
                by[r.source] += r.taken
            assert all(abs(by[r.source] - r.target) <= 2 * mixing.BLOCK for r in after.values())
    assert language_id.UNKNOWN == "und" and line_dedup.WORDS == 3


def test_run_on_rows_without_content(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "12", "en", "a", 2)], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_repeated_ids(spark, tmp_path):
    text = "many words that stand in this one text of the corpus and in no other text at all"
    rows = [(1, text, "en", "a", "s", 1.5, "x"), (1, "quite other words under the same id which are not near to the first ones", "en", "a", "t", 2.5, "y"), (2, text.upper(), "en", "b", "u", 3.5, "z")]
    rows += [(k, f"some plain english words number {k} of the training part of it all with a tail of {k * k}", "en", "b", "v", 0.0, "w") for k in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Size string, taken double, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "quite other words under")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "mix_size", "source_size", "target", "mix_taken"]
    left = {r.text for r in got.collect()}
    assert left <= {r[1] for r in rows} and rows[1][1] not in left and text.upper() not in left
    assert sorted(r.doc_id for r in simhash.deduplicated(docs.where("doc_id < 3")).collect()) == [1, 1]
