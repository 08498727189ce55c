"""Scalar functions on text, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_bytes(text: Column | str, n: int) -> Column:
    """The longest prefix of at most `n` UTF-8 bytes that does not split a character."""
    text = col(text)
    raw = text.cast("binary")
    cut = [F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) if k > 0 else F.lit("") for k in range(n, max(n - 4, -1), -1)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cut))


def clamp(text: Column | str, max_bytes: int) -> tuple[Column, Column]:
    """The text cut to `max_bytes` and whether that cut anything; 0 means no limit."""
    text = col(text)
    if max_bytes <= 0:
        return text, F.lit(False)
    return truncate_bytes(text, max_bytes), F.coalesce(F.octet_length(text) > max_bytes, F.lit(False))


def estimate_tokens(text: Column | str) -> Column:
    return F.floor(F.octet_length(F.coalesce(col(text), F.lit(""))) / 4)


def first_chars(text: Column | str, n: int = 80) -> Column:
    return F.left(col(text), F.lit(n))


def is_iso8601(text: Column | str) -> Column:
    """At least 19 bytes with the date's dashes and a T or a space before the time."""
    text = col(text)
    return F.coalesce((F.octet_length(text) >= 19) & text.rlike(r"^(?s).{4}-.{2}-.{2}[T ]"), F.lit(False))


def entry_timestamp(text: Column | str) -> Column:
    """ISO stamps and digit strings as they are, anything else "0"."""
    text = col(text)
    return F.when(is_iso8601(text) | text.rlike("^[0-9]+$"), text).otherwise("0")


def iso_from_millis(ms: Column | str, keep_millis: bool = True) -> Column:
    """UTC ISO stamp; milliseconds are written only if asked for and not zero (session time zone UTC)."""
    ms = col(ms)
    at = F.timestamp_millis(ms)
    plain = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.pmod(ms, F.lit(1000)) != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(plain) if keep_millis else plain


def stamp_digits(text: Column | str) -> Column:
    """The first 14 digits of a stamp or a session folder's name, as a number; null if there are fewer."""
    digits = F.regexp_replace(col(text), "[^0-9]", "")
    return F.when(F.length(digits) >= 14, F.left(digits, F.lit(14)).cast("long"))


def size_label(n: Column | str) -> Column:
    """One decimal of MB from a million bytes on, else whole KB."""
    n = col(n)
    return F.when(n >= 1_000_000, F.format_string("%.1fMB", n / 1e6)).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("KB")))


def summarize_tool_call(name: Column | str, args: Column | str) -> Column:
    """One line for a tool call: well-known tools by their telling argument, others by their compact arguments."""
    name, args = col(name), col(args)
    v = F.try_parse_json(args)
    text = lambda path, default="?": F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")), F.lit(default))
    octets = lambda path: F.octet_length(text(path, "")).cast("string")
    has_path = F.try_variant_get(v, "$.file_path", "variant").isNotNull()
    shown = {
        "bash": F.concat(F.lit("bash: "), truncate_bytes(text("$.command", ""), 300)),
        "write_file": F.concat(F.lit("write_file("), text("$.file_path"), F.lit(", "), octets("$.content"), F.lit(" chars)")),
        "edit": F.concat(F.lit("edit("), text("$.file_path"), F.lit(", "), octets("$.old_string"), F.lit(" chars replaced)")),
        "read_file": F.concat(F.lit("read_file("), F.when(has_path, text("$.file_path")).otherwise(text("$.path")), F.lit(")")),
        "grep": F.concat(F.lit("grep("), text("$.pattern"), F.lit(", "), text("$.path", "."), F.lit(")")),
        "task": F.concat(F.lit("task("), text("$.agent"), F.lit(")")),
        "todo": F.concat(F.lit("todo("), text("$.action"), F.lit(")")),
        "skill": F.concat(F.lit("skill("), text("$.name"), F.lit(")")),
    }
    out = F.when(v.isNull(), F.concat(name, F.lit("("), truncate_bytes(args, 200), F.lit(")")))
    for tool, line in shown.items():
        out = out.when(name == tool, line)
    return out.otherwise(F.concat(name, F.lit("("), truncate_bytes(F.to_json(v), 300), F.lit(")")))


def render_message(role: Column | str, content: Column | str, calls: Column | str) -> Column:
    """A message's block in a prompt; redacted first, cut second.  Null if it has nothing to show."""
    from threadmill.functions.redact import redact_secrets

    role, content, calls = F.upper(col(role)), F.coalesce(col(content), F.lit("")), F.coalesce(col(calls), F.array().cast("array<string>"))
    clean = redact_secrets(content)
    lines = F.transform(calls, lambda c: F.concat(F.lit("  "), role, F.lit(" -> "), redact_secrets(c)))
    more = lambda n, note: F.when(F.octet_length(clean) > n, F.array(F.lit(note))).otherwise(F.array().cast("array<string>"))
    tool = F.concat(F.array(F.concat(F.lit("  TOOL RESULT: "), truncate_bytes(clean, 500))), more(500, "  ... (truncated)"))
    other = F.concat(F.array(F.concat(F.lit("["), role, F.lit("]")), truncate_bytes(clean, 1500)), more(1500, "... (truncated)"))
    body = F.when(content == "", F.array().cast("array<string>")).otherwise(F.concat(F.when(role == "TOOL", tool).otherwise(other), F.array(F.lit(""))))
    block = F.concat(lines, body)
    return F.when(F.size(block) > 0, F.array_join(block, "\n"))


def query_tokens(query: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(col(query)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fragment(text: Column | str, query: Column | str, before: int = 50, after: int = 200) -> Column:
    """The surroundings of the first query token that the lower-cased text holds, about `before` and `after` bytes of
    the hit's place; whole characters only."""
    text, tokens = col(text), query_tokens(query)
    low = F.lower(text)
    places = F.filter(F.transform(tokens, lambda t: F.instr(low, t)), lambda p: p > 0)
    at = F.octet_length(F.left(low, F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - 1))
    start = F.greatest(at - before, F.lit(0))
    raw = F.substring(text.cast("binary"), start + 1, F.least(F.octet_length(text), at + after) - start)
    whole = [F.try_validate_utf8(F.substring(raw, F.lit(1 + i), F.octet_length(raw) - i - j).cast("string")) for i in range(4) for j in range(4)]
    return F.coalesce(*whole)


def tail_slice(text: Column | str, budget: int) -> Column:
    """The newest whole lines within `budget` bytes: from the first line start in the last `budget` bytes; null if none."""
    text = col(text)
    raw = F.substring(text.cast("binary"), F.greatest(F.octet_length(text) - budget, F.lit(0)) + 1, F.lit(budget))
    # look for the newline in bytes: a hex pair at an even place
    hexed = F.hex(raw)
    line = F.regexp_extract(hexed, r"^(?:(?!0A)..)*0A(.*)$", 1)
    return F.when(F.octet_length(text) <= budget, text).when(F.length(line) > 0, F.unhex(line).cast("string"))


def same_turn(a: Column | str, b: Column | str, least: int = 32) -> Column:
    """Equal after trimming, or one is a prefix of the other of `least` bytes or more."""
    a, b = F.trim(col(a)), F.trim(col(b))
    return (a == b) | ((F.octet_length(a) >= least) & b.startswith(a)) | ((F.octet_length(b) >= least) & a.startswith(b))


def item_key(content: Column | str) -> Column:
    """`itemN:` or `itemN.N:` before white space, else the content."""
    slug = F.regexp_extract(col(content), r"^(item\d+(?:\.\d+)?:)(?=\s)", 1)
    return F.when(slug != "", slug).otherwise(col(content))


def plural(n: Column | str, word: str) -> Column:
    n = col(n)
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
