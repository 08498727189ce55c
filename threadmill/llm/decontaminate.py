"""Benchmark decontamination by spaced seeds.

A seed looks at a window of words and ignores those at fixed places, so that a hit survives substitutions there.  The
seed hashes of all windows of all texts are joined with those of the benchmark items; each hit fixes an alignment (a
diagonal) of item and text, and the alignment is verified around the hit: some `window` words in a row of the item must
agree with the text but for substitutions, at `percent` of the places or more.  Whatever the places of the three
substitutions that 13 words may have, one of the masks meets a window without any (a test tries all), so no overlap is
lost, and none of shorter items down to 9 words.  Items of LEAST to SHORT words are looked for by their pairs of neighbouring words, which likewise always hit; the
texts are hashed for them only if there are such items.

Only built-in functions.  The benchmark's seeds, and the items, are broadcast if there are at most MAX_BROADCAST seeds and
MAX_ITEMS items of MAX_WORDS words together, else the joins shuffle.  Defined results: null text or item has no words; items
with fewer than LEAST words are never found (too short to tell); very long texts are read whole; a document with several
items gets all of them, ties included; repeated items each count; repeated rows of a doc_id are one document; a null doc_id
is never found; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut, id_bit, near_ids
from threadmill.llm.licenses import SEPARATOR

#: Places of the window that a seed looks at: of items with more than SHORT words, and of shorter ones.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
PAIR = (0, 1)
LEAST, SHORT = 4, 8
WINDOW, PERCENT = 13, 75
MAX_BROADCAST, MAX_ITEMS, MAX_WORDS = 1_000_000, 100_000, 4_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _seeds(words: str, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Seed hashes of the array column `words`: those of the first mask, then those of the second, each as long as it."""
    def of(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(words, lambda x, i: F.xxhash64(F.lit(k), *(x if not p else F.get(F.col(words), i + p) for p in mask)))

    return F.concat(*(of(k, mask) for k, mask in enumerate(masks)))


def seeds(words: DataFrame, masks: tuple[tuple[int, ...], ...], *keep: str) -> DataFrame:
    """(keep..., mask, pos, h) of every place of the array column `w` at which a mask's window fits.  The outer form of the
    generator keeps the optimizer from inferring a filter that would compute the seeds twice."""
    made = words.select(*keep, F.size("w").alias("n"), _seeds("w", masks).alias("s"))
    # the first mask's hashes stand first, then the second's: a place in the array tells both mask and word
    mask = sum(((F.col("p") >= k * F.col("n")).cast("int") for k in range(2, len(masks))), (F.col("p") >= F.col("n")).cast("int"))
    span = F.get(F.array(*(F.lit(max(m) + 1) for m in masks)), F.col("mask"))
    flat = made.select(*keep, "n", F.posexplode_outer("s").alias("p", "h")).withColumn("mask", mask)
    return flat.withColumn("pos", F.col("p") - F.col("mask") * F.col("n")).filter(F.col("pos") + span <= F.col("n")).select(*keep, "n", "mask", "pos", "h")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """A row per document, item and verified alignment: doc_id, item_id, start (word of the text where the item's first
    word would stand), n_agree (agreeing words in all), best (most in a window), item_words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") >= LEAST)
    sizes = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words"), F.coalesce(F.min(F.size("w")), F.lit(SHORT + 1)).alias("least")).first()
    used = (*masks, PAIR) if sizes["least"] <= SHORT else masks
    is_pair = F.col("mask") == len(masks)
    wanted = seeds(items, used, "item_id").filter(F.when(F.col("n") <= SHORT, is_pair).otherwise(~is_pair)).select("item_id", F.col("pos").alias("item_pos"), "h")
    few = sizes["n"] <= MAX_ITEMS and sizes["words"] <= MAX_WORDS and sizes["words"] * len(masks) <= MAX_BROADCAST
    wanted = F.broadcast(wanted) if few else wanted
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    hits = seeds(rows.select("doc_id", words_of(F.col("text")).alias("w")), used, "doc_id").join(wanted, "h").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("start")).distinct()
    length = items.select("item_id", F.size("w").alias("long"))
    sized = hits.join(F.broadcast(length) if few else length, "item_id")
    per_doc = sized.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "start", "long")).alias("hits"))
    found = cut(per_doc)
    some = rows.withColumn("bit", id_bit(F.col("doc_id"))).join(near_ids(found), "bit", "left_semi")
    texts = some.join(found, "doc_id").select("doc_id", words_of(F.col("text")).alias("w"), "hits")
    part = lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), F.slice("w", F.greatest(x["start"], F.lit(0)) + 1, x["long"]).alias("part"))
    near = texts.select("doc_id", F.explode_outer(F.transform("hits", part)).alias("hit")).select("doc_id", "hit.*")
    known = items.withColumnRenamed("w", "item")
    return _verified(near, F.broadcast(known) if few else known, window, percent)


def _verified(near: DataFrame, known: DataFrame, window: int, percent: int) -> DataFrame:
    shift = F.least(F.col("start"), F.lit(0))
    agree = F.transform("item", lambda x, i: F.when(i + shift >= 0, F.coalesce(F.get(F.col("part"), i + shift) == x, F.lit(False))).otherwise(False).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    at = near.join(known, "item_id").select("doc_id", "item_id", "start", agree.alias("agree"))
    long = F.least(F.size("agree"), F.lit(window))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("agree") - long + 1), lambda i: total(F.slice("agree", i, long))))
    out = at.select("doc_id", "item_id", "start", total(F.col("agree")).alias("n_agree"), best.alias("best"), F.size("agree").alias("item_words"), long.alias("long"))
    return out.filter(F.col("best") * 100 >= percent * F.col("long")).drop("long").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """A row per document that holds a passage of an item: doc_id, items (ids, ascending), n_items, n_agree (the most)."""
    found = overlaps(docs, benchmark, masks, window, percent)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count_distinct("item_id").alias("n_items"), F.max("n_agree").cast("long").alias("n_agree"))
