"""Every training word is clustered, not only the most frequent ones."""

import random

from pyspark.sql import functions as F

from threadmill.llm import perplexity


def test_rare_words_of_one_ending_get_their_own_classes(spark):
    rnd = random.Random(4)
    first, second = [f"ka{i}xyz" for i in range(20)], [f"mo{i}xyz" for i in range(20)]
    pick = lambda often, rare: rnd.choice(often) if rnd.random() < 0.7 else rnd.choice(rare)
    train = [(i, " ".join(f"{pick(['red', 'blue', 'green'], first)} {pick(['cat', 'dog', 'cow'], second)} runs" for _ in range(30))) for i in range(40)]
    right = " ".join(f"{a} {b} runs" for a, b in zip(first, second, strict=True))
    wrong = " ".join(f"{b} {a} runs" for a, b in zip(first, second, strict=True))
    df = spark.createDataFrame([*train, (1000, right), (1001, wrong), (1000, right)], "doc_id long, text string")
    for head in (8, 1 << 16):  # the rare words beyond the head, or in it
        got = [(r.doc_id, r.perplexity) for r in perplexity.score_texts(df, F.col("doc_id") >= 1000, head=head, members=7, classes=5).filter("doc_id >= 1000").collect()]
        assert len(got) == 3 and dict(got)[1000] < 0.7 * dict(got)[1001]
