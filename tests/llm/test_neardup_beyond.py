"""Links of members that are compared only among what is beyond their kept candidates."""

import random

import numpy as np

from threadmill.llm import linedup, neardup


def test_links_beyond_the_hubs_and_the_kept_candidates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{base} end{i}") for i in range(300)], "doc_id long, text string").repartition(6)
    for hubs, kept in ((0, 1), (2, 1), (4096, 4)):
        got = neardup.near_duplicates(df, k=2, hubs=hubs, kept=kept).collect()
        assert len(got) == 300 and {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_chains_by_hot_values_and_few_candidates(spark):
    """Neighbours in a chain are linked, others not; every value is listed with a second one, one candidate is kept."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(3):
        now = rnd.sample(words, 60)
        for _ in range(12):
            texts.append((len(texts), " ".join(now)))
            now = [*now[4:], *rnd.sample(words, 4)]
    rnd.shuffle(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)] + [(40, texts[3][1]), (2, texts[2][1])]
    sets = {i: {(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for i, t in texts}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert 3 <= len(set(root.values())) < 20
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for hot in (0, 1 << 16):
        got = neardup.near_duplicates(df, k=2, kept=1, hot=hot).collect()
        assert len(got) == len(texts) and {r.doc_id: r.component_id for r in got} == root


def test_lines_of_a_list_meet_those_of_like_sizes_alone():
    """Of a list with lines of many sizes only pairs whose sizes can match are made, and none of the matches is missed."""
    r = np.random.default_rng(4)
    n = 3000
    made = np.sort(r.integers(5, 500, n))
    x = {"word": np.zeros(n, np.uint64), "doc_id": r.permutation(n), "line": np.zeros(n, np.int64), "m": made, "pos": np.zeros(n, np.int64), "bits": r.integers(0, 4, n).astype(np.uint64), "at": np.full(n, -1), "rest": np.zeros((0, 3), np.uint64)}
    lists, seen = linedup.LineLists(80, 4096, n), []
    inner = lists.possible
    lists.possible = lambda x, i, j: seen.append(len(i)) or inner(x, i, j)
    got = {(i, j) for a, b, *_ in lists.pairs(x, x["word"]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.nonzero(x["doc_id"][:, None] > x["doc_id"][None, :])
    ok, _ = inner(x, i, j)
    assert got == set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    assert sum(seen) < n * (n - 1) // 2 // 3
