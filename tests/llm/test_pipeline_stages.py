"""Each stage of the pipeline against a brute-force version on a small table with the awkward rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadmill.llm import decontaminate, mixing, toxicity

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    line, body = prose(15), prose(90)
    near = body.split()
    near[45] = "changed"
    texts = [body, " ".join(near), body + " end", prose(40) + "\n" + line, line + "\n" + prose(20), line.upper(), None, "", " \n", "one", prose(30) + " " + item + " " + prose(5), prose(4000), *(prose(rnd.randint(1, 50)) for _ in range(20))]
    made = [(i * 2, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*made, made[3], (None, body, "en", None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit("more") for c in ("rep", "root", "bit", "size", "kept", "line", "v", "removed", "score")}
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(clash)


def shown(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_line_dedup(spark, docs, rows, sf_dir):
    seen, gone = [], collections.defaultdict(set)
    for i, t in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        for j, x in enumerate(t.split("\n")):
            s = set(x.lower().split())
            if s and any(100 * len(s & u) >= 80 * len(s | u) for u in seen):
                gone[i].add(j)
            seen += [s] if s else []
    want = sorted(((i, t if t is None or i is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])) for i, t, *_ in rows), key=repr)
    out = STAGES["line_dedup"](spark, docs, sf_dir)
    assert shown(out) == want and out.columns == docs.columns and any(gone.values())


def test_near_dedup(spark, docs, rows, sf_dir):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted(((i, t) for i, t, *_ in rows if i is None or root[i] == i), key=repr)
    out = STAGES["near_dedup"](spark, docs, sf_dir)
    assert shown(out) == want and out.columns == docs.columns and len(want) < len(rows)


def test_decontamination(spark, docs, rows, sf_dir):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [re.findall(word, (r.text or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def holds(t):
        w = re.findall(word, (t or "").lower())
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for x in items:
            n = min(len(x), decontaminate.WINDOW)
            if len(x) >= decontaminate.LEAST:
                hits = collections.defaultdict(set)
                for j, y in enumerate(x):
                    for i in at[y]:
                        hits[i - j].add(j)
                if any(100 * sum(j in h for j in range(k, k + n)) >= decontaminate.PERCENT * n for h in hits.values() for k in range(len(x) - n + 1)):
                    return True
        return False

    want = sorted(((i, t) for i, t, *_ in rows if i is None or not holds(t)), key=repr)
    out = STAGES["decontamination"](spark, docs, sf_dir)
    assert shown(out) == want and out.columns == docs.columns and len(want) < len(rows)


def test_toxicity_and_mixing(spark, docs, rows, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flagged = {r.doc_id for r in toxicity.classify(known, labels).filter("toxic").collect()}
    kept = STAGES["toxicity"](spark, known, sf_dir)
    assert flagged and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in known.collect() if r.doc_id not in flagged) and kept.columns == known.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.water_fill([total[s] for s in order], [(1.0, 2.0, 3.0)[i % 3] for i in range(len(order))], 3.0), strict=True))
    out = STAGES["mixing"](spark, docs, sf_dir).collect()
    assert len(out) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == total[r.source] for r in out)


def test_empty_tables(spark, docs, sf_dir):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
