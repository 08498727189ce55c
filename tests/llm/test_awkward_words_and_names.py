"""Words that a polynomial modulo 2**64 cannot tell apart, texts that say nothing, and columns with odd names."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import linedup, neardup, perplexity, toxicity
from threadmill.llm.common import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n=10):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_are_told_apart(spark):
    a, b = thue_morse()
    h = word_hashes(np.frombuffer(f"{a} {b} {a.upper()}".encode(), np.uint8), np.array([0]))[0]
    assert h[0] != h[1] and h[0] == h[2]
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, a, "en", "s", 1)], SCHEMA)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, k=2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}
    lines = spark.createDataFrame([(1, f"{a} one two three four five six", "en", "s", 1), (2, f"{b} one two three four five six", "en", "s", 1), (3, a, "en", "s", 1), (4, b, "en", "s", 1)], SCHEMA)
    removed = {r["doc_id"] for r in linedup.removed_lines(lines).collect()}
    assert 4 not in removed
    scored = {r["doc_id"]: r["n_known"] for r in perplexity.score_texts(spark.createDataFrame([(1, a, "en", "s", 1), (2, b, "en", "s", 1)], SCHEMA), F.col("doc_id") == 2).collect()}
    assert scored[2] == 1  # the end alone


def test_texts_that_say_nothing_stay(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([None, "", " \n ", "?!"])], SCHEMA)
    odd = [(100 + i, f"plain word{i % 7} here", "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(100 + i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    every = docs.union(spark.createDataFrame(odd, SCHEMA))
    left = {r["doc_id"] for r in toxicity.without_toxic(every, labels).collect()}
    assert {0, 1, 2} <= left
    assert all(r["score"] == 0 for r in toxicity.classify(every, labels).collect() if r["doc_id"] < 3)


def test_stages_take_odd_column_names(spark, sf_dir):
    rows = [(i, f"this is document number {i} with quite a few words of its own {i * i}", "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"a.b": F.lit("x"), "again_id": F.lit(1), "found_id": F.lit(2), "we`ird": F.lit(3), "gone": F.lit("y")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() == 12, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 12
