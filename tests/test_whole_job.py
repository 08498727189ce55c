"""Queries do the whole of their job."""

import hashlib

from threadmill.operators import budget
from threadmill.plans import catalog
from threadmill.sources.tables import table


def test_greedy_admission_of_a_long_session(spark):
    rows = [("hot", i, 7 if i % 1500 == 0 else 100 if i < 1200 else None if i == 1201 else 9) for i in range(2600)] + [("b", 0, 3), (None, 0, 4)]
    df = spark.createDataFrame(rows, "session_id string, seq long, len long").repartition(3)
    want, used, n = {("b", 0): True, (None, 0): True}, 1, 0
    for s, i, size in rows[:2600]:
        ok = None if size is None else used + (n > 0) + size + 1 <= 60
        used, n = (used + (n > 0) + size, n + 1) if ok else (used, n)
        want[s, i] = ok
    got = budget.greedy_admission(df, 60, "len").collect()
    assert len(got) == len(rows) and {(r.session_id, r.seq): r.admitted for r in got} == want
    assert sum(bool(x) for (s, i), x in want.items() if i >= 1000) > 2


def test_fragments_of_all_documents(spark, sf_dir):
    want, wide = {}, 0
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        low = (r.text or "").lower()
        at = next((i for i in (low.find("license"), low.find("the")) if i >= 0), None)
        if at is None:
            continue
        raw, b = r.text.encode(), len(low[:at].encode())
        want[r.doc_id] = hashlib.md5(raw[max(b - 50, 0) : b + 200].decode("utf-8", "ignore").encode()).hexdigest()
        wide += len(raw) != len(r.text)
    got = {r.doc_id: r.fragment for r in catalog.queries()["search_fragment_all"](spark, sf_dir).collect()}
    assert got == want and wide > 0
