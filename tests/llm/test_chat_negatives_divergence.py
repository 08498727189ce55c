"""Chat formatting, hard negatives and the source audit against brute force on small tables with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import chat, divergence, negatives

RND = random.Random(7)
TURNS = "conv_id long, turn long, role string, text string"
HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_sep|>", "a\nb<|nl|>", "<<|>|<|", "", None, "É ünï 日本 𝄞", "x" * 100_000, "<|im_sep|>", "\\", "<|im_end|>\n"]


def conversations():
    rows = [(c, t, RND.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|im_start|>"]), RND.choice(HARD)) for c in range(12) for t in range(RND.randint(1, 9))]
    rows += [(100, t, "assistant" if t % 3 else "user", f"turn {t} <|") for t in range(-5, 1200)]  # several segments
    rows += [(101, 7, "user", "b"), (101, 7, "user", "a"), (101, 7, "assistant", "z"), (101, None, "user", "first")]
    return [*rows, rows[3], (None, 0, "user", "no id"), (None, 1, "assistant", "all the same"), (102, 255, "user", "x"), (102, 256, "user", "y")]


def test_chat_format(spark):
    rows = conversations()
    odd = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("extra") for c in ("turns", "body", "a.b", "segment", "part")}).repartition(3)
    formatted = chat.format_conversations(odd)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    whole = {r["conv_id"]: r for r in formatted.collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
        text, spans, prev = "", [], None
        for _, role, said in turns:
            text += "<|im_sep|>" if role == prev else ("" if prev is None else "<|im_end|>\n") + "<|im_start|>" + esc(role).replace("\n", "<|nl|>") + "\n"
            if role == "assistant":
                spans.append((len(text.encode()), len(esc(said).encode())))
            text, prev = text + esc(said), role
        text += "<|im_end|>\n"
        assert whole[c]["formatted"] == text
        assert [tuple(x) for x in whole[c]["loss"]] == spans
        learnt = "".join(s for _, r, s in turns if r == "assistant")
        said = "".join(f"{r}\n{s}\n" for _, r, s in turns)
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text))
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) == want


def test_chat_of_nothing(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_escapes_come_back(spark):
    texts = ["".join(RND.choice("<|\\>a\n") for _ in range(RND.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in out)


VECTORS = "vec_id long, label long, embedding array<float>"


def vectors():
    base = [[RND.uniform(-1, 1) for _ in range(7)] for _ in range(60)]
    rows = [(i, RND.randint(0, 3), RND.choice(base)) for i in range(300)]  # many equal vectors
    rows += [(1000, None, base[0]), (1010, 1, None), (1020, 1, [0.5, None]), (1030, 2, [float("nan")]), (1040, 2, [float("inf"), 1.0]), (None, 1, base[3]), (1050, 1, []), (1060, 9, base[1]), (1070, 1, base[2][:3])]
    return [*rows, rows[20], rows[20], rows[33]]


def mined(rows, every, k, m):
    fine = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        fine.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    big = 1 << 62
    out = collections.Counter()
    for a, al, av in fine:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, v)), big if i is None else i, i, lab) for i, lab, v in fine), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == al and x[2] != a][:k]:
            some = [x for x in scored if x[3] != al and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            for n, (t, _, i, _) in enumerate(some):
                out[a, p, n + 1, i, -s, -t] += 1
    return out


@pytest.mark.parametrize(("block", "anchors", "chunk"), [(2048, 256, 32), (16, 8, 3)])
def test_hard_negatives(spark, block, anchors, chunk):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit("extra") for c in ("uid", "a.b", "score", "i", "k")})
    ready = df.select(F.col("vec_id").alias("id"), "label", negatives.integers(F.col("embedding")).alias("q"))
    got = negatives.mine(ready, F.col("id") % 10 == 0, block=block, anchors=anchors, chunk=chunk)
    found = collections.Counter(tuple(r) for r in got.collect())
    assert found == mined(rows, 10, 5, 5)
    assert any(n for (_, _, r, *_), n in found.items() if r == 5)


def test_hard_negatives_of_nothing(spark):
    shape = "id long, label long, q array<long>"
    assert negatives.mine(spark.createDataFrame([], shape), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1])], shape), F.col("id") % 10 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(10, 1, [1])], shape), F.col("id") % 10 == 0).count() == 0


def test_products_beyond_floats_are_exact():
    r = np.random.default_rng(3)
    a, b = r.integers(-(2**29), 2**29, (5, 9)), r.integers(-(2**29), 2**29, (4, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert negatives.product(a, b).tolist() == want
    x = np.array([[2**31, -3]])
    assert np.frombuffer(negatives.packed(x)[0], negatives.packed(x)[1]).tolist() == [2**31, -3]


def documents():
    words = ["Alpha", "beta", "été", "gamma", "日本", "DELTA", "e", "zeta-eta", "x1y2", "Ömega"]
    rows = []
    for i in range(160):
        lang, source = RND.choice(["en", "de", None, "xx"]), RND.choice(["s1", "s2", "s3", None, "é", "z"])
        rows.append((i, " ".join(RND.choice(words + [f"{source}w", f"rare{i % 50}"]) for _ in range(RND.randint(0, 40))), lang, source, 0))
    rows += [(500, None, "en", "silent", 0), (501, "", "none", "a", 0), (502, "once", "none", "b", 0), (503, "word " * 60_000, "en", "s1", 0), (None, None, None, None, None)]
    return [*rows, rows[4], rows[4]]


def audit(rows, least=3, most=200):
    terms = lambda t: re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    docs = [(lang or "", source or "", [w.decode() for w in terms(t)]) for _, t, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        groups = {s: collections.Counter(w for d in mine if d[1] == s for w in d[2] if df[w] >= least) for s in {d[1] for d in mine}}
        p_of = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: p_of(c) for s, c in groups.items()}, p_of(sum(groups.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, n + 1) for n, (v, o) in enumerate(pairs)}
            own = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if groups[s][w] and p[s][w] > q[w])[:most]
            out |= {(lang, s, "term", w.decode(), -v, n + 1) for n, (v, w) in enumerate(own)}
    return out


@pytest.mark.parametrize("held", [divergence.HELD, 40])
def test_source_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).withColumns({c: F.lit("extra") for c in ("gid", "lid", "a.b", "value", "rank")})
    assert {tuple(r) for r in divergence.divergences(df).collect()} == audit(rows)


def test_few_terms_stand_out(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    assert {tuple(r) for r in divergence.divergences(df, most=3).collect()} == audit(rows, most=3)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    text = b"one two three two \xc3\xa9t\xc3\xa9 one"
    low, s, e = divergence.slices(np.frombuffer(text, np.uint8), np.array([0, 8, len(text)]))
    for weak in (divergence.xxh, lambda b: len(b), lambda b: 1):
        monkeypatch.setattr(divergence, "xxh", weak)
        group, found, _ = divergence.grouped(low, s, e)
        assert [found[g] for g in group.tolist()] == [text[a:b] for a, b in zip(s.tolist(), e.tolist())]


def test_shares_are_exact():
    total = np.array([3, 10**15, 7 * 10**14 + 1])
    count = np.array([1, 10**15 - 1, 123456789012345])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]
