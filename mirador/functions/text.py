"""Text rules as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags out, common entities in, spaces single."""
    text = html
    for name in ("script", "style"):
        text = F.regexp_replace(text, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def first_match(text: Column, rules: dict[str, str], other: str) -> Column:
    """Name of the first pattern that the text has."""
    out = None
    for name, pattern in rules.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def _canonical(text: str | None) -> str | None:
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def none(name):
        raise ValueError(f"{name} is no number")

    try:
        value = json.loads(text, object_pairs_hook=once, parse_constant=none)
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None


def canonical_json(text: str) -> Column:
    """JSON with its keys sorted at every depth and no spaces; null where the text is none, has
    a key twice in an object, or a number that isn't finite."""

    def each(part: pd.Series) -> pd.Series:
        return part.map(_canonical, na_action="ignore")

    return F.pandas_udf(each, "string")(text)
