"""Surrogates where a format has few or none."""

from threadmill.llm import surrogates


def test_no_entity_fails_the_query(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 3)
    texts = ["password: ________", "token = --------", "mail _@-.com or _@-.COM", *(f"secret=-------{i}" for i in range(10)), "secret=abcdefgh9", "ssn 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(df, "k").collect()}
    assert len(got) == len(texts) and [got[i].text for i in (0, 1)] == texts[:2] and got[0].n_entities == 0
    a, b = got[2].text.removeprefix("mail ").split(" or ")
    assert a == b.lower() and a.endswith(".com") and "_@-" not in a
    new = [got[i].text for i in range(3, 13)]
    assert len(set(new)) == 10 and not set(new) & set(texts) and all(got[i].text != texts[i] for i in range(2, len(texts)))


def test_digits_beyond_their_format(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ROUNDS", 2)
    ents = spark.createDataFrame([("ssn", str(i)) for i in range(10)], "kind string, canon string")
    got = surrogates.assign(ents, "k").collect()
    assert len({r.new for r in got}) == 10 and not {r.new for r in got} & {str(i) for i in range(10)}
