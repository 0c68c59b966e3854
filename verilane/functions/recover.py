"""JSON objects out of replies that are almost JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_ENDS = {"{": "}", "[": "]"}


def repaired(reply: str | None) -> str | None:
    """The object that begins at the first brace, as JSON: quotes inside a string are escaped, and what is open at the end is closed.

    A quote ends its string only before a colon, a closing bracket, the end, or a comma with a new quote, number or bracket after it. None if no object comes out.
    """
    start = (reply or "").find("{")
    if start < 0:
        return None
    text, out, open_, inside, k = reply[start:], [], [], False, 0
    while k < len(text):
        c = text[k]
        if inside and c == "\\":
            out.append(text[k : k + 2])
            k += 2
            continue
        if c == '"':
            rest = text[k + 1 :].lstrip() if inside else ""
            after = rest[1:].lstrip()[:1] if rest[:1] == "," else ""
            ends = not rest or rest[0] in ":}]" or (rest[0] == "," and (after == "" or after in '"{[-}]' or after.isdigit()))
            if inside and not ends:
                out.append("\\")
            else:
                inside = not inside
        elif not inside and c in _ENDS:
            open_.append(_ENDS[c])
        elif not inside and open_ and c == open_[-1]:
            open_.pop()
        out.append(c)
        k += 1
        if not open_:
            break
    body = "".join(out) + ('"' if inside else "")
    body = body if not open_ else body.rstrip().rstrip(",") + "".join(reversed(open_))
    try:
        found = json.loads(body, strict=False)
    except json.JSONDecodeError:
        return None
    return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) and found else None


@pandas_udf(StringType())
def _repair(reply: pd.Series) -> pd.Series:
    return reply.map(repaired, na_action="ignore")


@pandas_udf(StringType())
def _strict(reply: pd.Series) -> pd.Series:
    def one(text):
        try:
            found = json.loads(text)
        except (TypeError, json.JSONDecodeError):
            return None
        return text if isinstance(found, dict) else None

    return reply.map(one)


def json_object(reply: Column) -> Column:
    """The JSON of the first that is an object: the whole reply, its fenced block, its outermost braces, the repaired reply. Null if none is."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(_strict(F.trim(reply)), _strict(fenced), _strict(braces), _repair(reply))
