"""Answers written as literals inside tool results: not a regular language, so an Arrow UDF reads them, token by token."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))
ANSWERS = T.StructType([T.StructField("records", RECORDS), T.StructField("cancelled", T.BooleanType())])
#: A quoted string with escapes, a sign, or a bare word.
_TOKEN = re.compile(r"""'(?P<single>(?:[^'\\]|\\.)*)'|"(?P<double>(?:[^"\\]|\\.)*)"|(?P<sign>[{}\[\]:,])|(?P<bare>[^\s{}\[\]:,'"]+)""", re.S)
_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\s*=\s*"((?:[^"\\]|\\.)*)")?', re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_MEANT = {"n": "\n", "t": "\t"}


def unescaped(s: str) -> str:
    return _ESCAPE.sub(lambda m: _MEANT.get(m[1], m[1]), s)


def tokens(s: str) -> list[tuple[str, str]]:
    """(kind, value) of each token: `text` for a quoted string, `sign` or `bare`."""
    found = []
    for m in _TOKEN.finditer(s):
        kind = m.lastgroup
        found.append(("text", unescaped(m[kind])) if kind in ("single", "double") else (kind, m[kind]))
    return found


def answer_text(content: str | None) -> tuple[list[dict[str, str | None]], bool]:
    """The records of `answers: [{'question': ..., 'answer': ...}, ...]` that have an answer, and whether the text says
    `cancelled: true`."""
    content = content or ""
    cancelled = re.search(r"cancelled:\s*true\b", content, re.I) is not None
    _, said, tail = content.partition("answers:")
    begin, end = tail.find("["), tail.rfind("]")
    if not said or begin < 0 or end < begin:
        return [], cancelled
    records, fields, key, depth = [], {}, None, 0
    waiting = False  # for the value of a key
    for kind, value in tokens(tail[begin + 1 : end]):
        if kind == "sign" and value == "{":
            depth += 1
            fields, key, waiting = ({}, None, False) if depth == 1 else (fields, key, waiting)
        elif kind == "sign" and value == "}":
            depth -= depth > 0
            if not depth and "answer" in fields:
                records.append({"question": fields.get("question"), "answer": fields["answer"]})
                fields = {}
        elif depth != 1 or kind == "sign" and value in "[]":
            continue
        elif kind == "sign":
            waiting = value == ":" and key is not None
            key = key if waiting else None
        elif waiting:
            # words without quotes go on until the next sign
            fields[key] = f"{fields[key]} {value}" if kind == "bare" and key in fields else value
            waiting = kind == "bare"
        else:
            key = value if kind == "text" else None
    return records, cancelled


def quoted_pairs(text: str | None) -> list[dict[str, str | None]]:
    """Every `"question"="answer"` of a text."""
    return [{"question": unescaped(m[1]), "answer": unescaped(m[2])} for m in _PAIR.finditer(text or "") if m[2] is not None]


@F.pandas_udf(ANSWERS)
def parse_answers(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([answer_text(c) for c in content], columns=["records", "cancelled"])


@F.pandas_udf(RECORDS)
def parse_quoted_pairs(content: pd.Series) -> pd.Series:
    return content.map(quoted_pairs)
