"""PII: surrogate generation.

Detected entities (e-mail, IP address, phone, payment card of an issuer's number range, social security number, IBAN,
access key, assigned secret, person after a form of address) get keyed replacements of the same type.  A surrogate depends
on the key, the type and the entity's canonical form alone, so all mentions of an entity, in whatever formatting and in
all documents, get the same one (coreference); of a person each name has its own, so "Mr A B" and "Mr A" share it.  It is laid into the mention's own format: digits stand where digits stood, letters keep their
case and script, card numbers keep their first digit and are valid under the Luhn check, names keep gender and script.  Surrogates are checked:
where two entities of a type drew the same one, or one that is itself an entity found, all but the first draw again,
until all are distinct.  An entity whose format has none left (or nothing to draw) gets a keyed digest instead, which
leaves the format but is distinct too.

Only built-in functions.  Defined results: null text stays null with 0 entities; text without entities is unchanged;
very long texts are rewritten whole, and no pattern nests one repetition in another without a bound, so none overflows;
where patterns tie at a place the first type of PATTERNS wins; repeated rows are rewritten alike; an empty table gives an
empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut, id_bit, near_ids

# Forms of address by gender.
MALE = ("Mr", "Sir", "Dr", "Prof", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа")
_TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
# Names of secrets, and first digits of payment cards with 16 digits.
_SECRETS = "password|passwd|token|secret|api_key|apikey|api-key"
_ISSUER = r"(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6011|64[4-9]\d|65\d{2}|35\d{2})"
#: Types in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<=(?i:{_SECRETS}) {{0,2}}[=:] {{0,2}}[\"']?)(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{{8,}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": rf"(?<![\d.-])(?:{_ISSUER}(?:[ -]\d{{4}}){{3}}|{_ISSUER}\d{{12}}|3[47]\d{{13}}|3[47]\d{{2}}[ -]\d{{6}}[ -]\d{{5}})(?!\d)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}*+(?: \p{{Lu}}\p{{L}}++)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No text without one of these holds an entity.
HINT = rf"[0-9@]|AKIA|(?i:{_SECRETS}) {{0,2}}[=:]|(?:{_TITLES})\.? \p{{Lu}}"
ROUNDS = 12
#: Syllables from which names are made, by script.
_LATIN = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
_CYRILLIC = [a + b for a in "бвгдзклмнпрстф" for b in "аеиоу"]
_GREEK = [a + b for a in "βγδκλμνπρστφ" for b in "αειου"]


def kind_of(mention: Column) -> Column:
    return F.coalesce(*(F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k != "secret"), F.lit("secret"))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common: an array, of a person's names one each, else of one."""
    name = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    female = mention.rlike(rf"^(?:{'|'.join(FEMALE)})\.? ")
    names = F.transform(F.split(F.lower(name), " "), lambda n: F.concat(F.when(female, "f:").otherwise("m:"), n))
    one = F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(mention, r"\D", "")).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)
    return F.when(kind == "person", names).otherwise(F.array(one))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _redraw(x: Column, draw: Column) -> Column:
    """`x` with every ASCII letter and digit drawn anew within its class; the first digit is not 0 unless it was."""
    digits, small, large = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda letters, i, seed: F.substring(F.lit(letters), (F.pmod(F.xxhash64(seed, i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    new = lambda c, i, d: F.when(c.between("1", "9") & (i == 0), pick(digits[1:], i, d)).when(c.between("0", "9"), pick(digits, i, d)).when(c.between("a", "z"), pick(small, i, d)).when(c.between("A", "Z"), pick(large, i, d)).otherwise(c)
    # as an element of an array the draw is made once, not for every character
    return F.get(F.transform(F.array(draw), lambda d: F.array_join(F.transform(_chars(x), lambda c, i: new(c, i, d)), "")), F.lit(0))


def _luhn(digits: Column) -> Column:
    """`digits` with the last one set so that the Luhn sum is a multiple of ten."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weigh = lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.reverse(_chars(body)), weigh), F.lit(0), lambda s, x: s + x)
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _name(canon: Column, draw: Column) -> Column:
    """A capitalised word in the name's script, whose ending shows the gender."""
    female = canon.startswith("f:")

    def made(syllables: list[str], ends: tuple[str, str], seed: Column) -> Column:
        table = F.array(*map(F.lit, syllables))
        stem = F.concat(*(F.get(table, F.pmod(F.shiftrightunsigned(seed, 6 * i), F.lit(len(syllables))).cast("int")) for i in range(4)))
        return F.initcap(F.concat(stem, F.when(female, ends[0]).otherwise(ends[1])))

    seed = F.xxhash64(draw)
    return F.when(canon.rlike(r"\p{IsCyrillic}"), made(_CYRILLIC, ("на", "н"), seed)).when(canon.rlike(r"\p{IsGreek}"), made(_GREEK, ("να", "νος"), seed)).otherwise(made(_LATIN, ("na", "n"), seed))


def surrogate(kind: Column, canon: Column, key: Column, attempt: Column) -> Column:
    """The canonical form of the replacement that the given attempt draws."""
    draw = F.sha2(F.concat_ws("|", key, kind, attempt.cast("string"), canon), 256)
    octet = lambda i: (F.pmod(F.xxhash64(draw, F.lit(i)), F.lit(254)) + 1).cast("string")
    at = F.regexp_extract(canon, r"^(.*)(\.[^.]*)$", 1)
    return (
        F.when(kind == "email", F.concat(_redraw(at, draw), F.regexp_extract(canon, r"^(.*)(\.[^.]*)$", 2))).when(kind == "ip", F.concat_ws(".", *map(octet, range(4))))
        .when(kind == "card", _luhn(F.concat(F.substring(canon, 1, 1), _redraw(F.substring(canon, 2, 64), draw)))).when(kind == "key", F.concat(F.lit("AKIA"), _redraw(F.substring(canon, 5, 64), draw)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _redraw(F.substring(canon, 3, 64), draw))).when(kind == "person", _name(canon, draw)).otherwise(_redraw(canon, draw))
    )


def last_resort(kind: Column, canon: Column, key: Column) -> Column:
    """A replacement where the format has no free one: a keyed digest of 256 bits, so distinct from all others."""
    digest = F.sha2(F.concat_ws("|", key, F.lit("last resort"), kind, canon), 256)
    mail = F.concat(F.substring(digest, 1, 32), F.lit("@"), F.substring(digest, 33, 32), F.regexp_extract(canon, r"(\.[^.]*)$", 1))
    return F.when(kind == "email", mail).when(kind == "secret", digest).otherwise(F.concat(kind, F.lit("-"), digest))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct surrogates for distinct (kind, canon): kind, canon, new.  Draws are repeated for all but the first of those
    that collide with each other or with a real entity; each round touches only what is still open.  What has nothing to
    draw, and what is open after the rounds, gets its last resort."""
    keyed = F.lit(key)
    real = entities.select("kind", F.regexp_replace("canon", "^[fm]:", "").alias("new")).distinct()
    fixed = (F.col("kind") == "email") & ~F.regexp_replace("canon", r"\.[^.]*$", "").rlike("[A-Za-z0-9]")
    resort = lambda df: df.select("kind", "canon", last_resort(F.col("kind"), F.col("canon"), keyed).alias("new"))
    plain = lambda new: F.when(F.col("kind") == "person", F.lower(new)).otherwise(F.col(new)).alias("plain")
    done, open_ = resort(entities.filter(fixed)), entities.filter(~fixed).select("kind", "canon")
    for attempt in range(ROUNDS):
        drawn = open_.withColumn("new", surrogate(F.col("kind"), F.col("canon"), keyed, F.lit(attempt)))
        free = drawn.withColumn("plain", plain("new")).join(real.union(done.select("kind", "new")).select("kind", plain("new")).distinct(), ["kind", "plain"], "left_anti")
        first = cut(free.groupBy("kind", "plain").agg(F.min("canon").alias("canon"), F.min_by("new", "canon").alias("new")).select("kind", "canon", "new"))
        done, open_ = done.union(first), cut(open_.join(first, ["kind", "canon"], "left_anti"))
        if open_.isEmpty():
            return done
    return done.union(resort(open_))


def _laid(kind: Column, mention: Column, news: Column) -> Column:
    """The surrogates (`news`: one for each part of the canonical form) in the mention's own format."""
    new = F.get(news, F.lit(0))
    digits = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.between("0", "9"), F.substring(new, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c != " ", F.substring(new, F.length(F.replace(F.substring(mention, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    names = F.split(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", ""), " ")
    cased = F.array_join(F.zip_with(names, news, lambda name, x: F.when((name == F.upper(name)) & (F.length(name) > 1), F.upper(x)).otherwise(x)), " ")
    mail = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(new)).otherwise(new)
    fits = F.length(new) < 64  # a last resort is laid as it is
    return F.when(fits & kind.isin("card", "phone", "ssn"), digits).when(fits & (kind == "iban"), spaced).when(kind == "person", F.concat(title, cased)).when(kind == "email", mail).otherwise(new)


def mentions(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that hold entities: row, doc_id, text, found (their mentions, in order)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = rows.filter(F.col("text").rlike(HINT)).withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    return seen.filter(F.size("found") > 0)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_entities, kinds (distinct, ascending), text with surrogates."""
    held = cut(mentions(docs))
    kind, mention = F.col("kind"), F.col("mention")
    each = held.select("row", F.posexplode_outer("found").alias("pos", "mention")).withColumn("kind", kind_of(mention))
    parts = each.select("row", "pos", "mention", "kind", F.posexplode(canonical(kind, mention)).alias("part", "canon"))
    new = assign(cut(parts.select("kind", "canon").distinct()), key)
    # one entity may be mentioned in a third of all rows: the side with a row per entity is met under salts
    salts = 16
    salted = new.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = parts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["kind", "canon", "salt"])
    in_order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    laid = met.groupBy("row", "pos", "kind", "mention").agg(in_order("part", "new").alias("news")).select("row", "pos", "kind", _laid(kind, mention, F.col("news")).alias("new"))
    by_row = laid.groupBy("row").agg(in_order("pos", "new").alias("new"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = held.join(by_row, "row").select("doc_id", F.size("found").cast("long").alias("n_entities"), "kinds", text.alias("text"))
    # the patterns are tried again only on texts whose bit one with entities has too
    dirty = near_ids(held.select(F.col("text").alias("doc_id"))).withColumn("hit", F.lit(True))
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bit", id_bit(F.col("text"))).join(dirty, "bit", "left")
    clean = rest.filter(F.col("hit").isNull() | ~F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False)))
    return clean.select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text").union(changed)
