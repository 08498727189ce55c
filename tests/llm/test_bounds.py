"""What a step holds or moves stays in proportion to what it needs."""

import os
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from threadmill.llm import common, linedup, toxicity


def test_few_other_lines_are_picked_with_the_wanted_ones(spark):
    """A quarter of a million wanted lines bring few of as many others."""
    docs = spark.range(0, 500, 1, 8).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("string")), "\n").alias("text"))
    need = spark.range(0, 500, 2, 8).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.struct(F.col("id").alias("doc_id"), i.cast("int").alias("line")))).alias("x"))
    got = linedup.picked(docs, need).groupBy((F.col("x.doc_id") % 2).alias("other")).agg(F.count("*").alias("n"), F.countDistinct("x").alias("once"), F.bool_and(F.regexp_replace(F.col("text").cast("string"), "\n", "") == F.col("x.line").cast("string")).alias("same")).collect()
    got = {r.other: r for r in got}
    assert got[0].n == got[0].once == 250_000 and all(r.same for r in got.values())
    assert 1 not in got or got[1].n < 250_000 * 3 // 100


def test_a_chain_is_fitted_in_little_memory():
    """The cells in which features are counted are many; few arrays of their length are made."""
    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, toxicity.CELLS, 50)), i % 2) for i in range(200)]
    rows = [(np.append(c, 7), t) if t else (c, t) for c, t in rows]
    tracemalloc.start()
    chain = toxicity.fit_chain(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(chain.cells) == [7] and most < 80e6


def test_waiting_workers_give_back_what_they_freed(spark):
    """A Python worker waits for later tasks, and its executor has its memory: what a task has freed must not stay with it."""

    def work(batch):
        many = [np.ones(1 << 13) for _ in range(3200)]  # 200 MB in pieces of the heap, of which a few stay between the others
        os.stay = many[::64]
        return {"pid": np.array([os.getpid()]), "n": np.array([len(many)])}

    (r,) = common.per_batch(spark.range(1).coalesce(1), "pid long, n long", work).collect()
    with open(f"/proc/{r.pid}/smaps_rollup") as held:  # in local mode the worker is on this machine
        assert r.n == 3200 and int(re.search(r"\nPss_Anon:\s+(\d+)", held.read())[1]) < 150 * 1024
