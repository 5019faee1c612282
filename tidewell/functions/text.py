"""Text, domain, time and number normalisation as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: Letters of the basic plane that decompose to an ASCII letter or digit and marks, with what is left without the marks.
_MARKED = {c: base for c in map(chr, range(0xC0, 0xFFFE)) if (base := unicodedata.normalize("NFD", c)[0]) != c and base.isascii() and base.isalnum()}


def _bound(x: Column, of) -> Column:
    """of(x) with x computed once, however often `of` names it."""
    return F.transform(F.array(x), of)[0]


def clean_text(raw: Column, longest: int) -> Column:
    """Markup, entities, truncation marks and control characters to spaces, spaces collapsed, cut with an ellipsis; null if empty.

    Each step runs where its first character is there. Numbers of characters are decoded first, then named entities in one pass, so what
    a name gives stays as text.
    """

    def markup(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("<")), F.regexp_replace(F.regexp_replace(t, V.SCRIPTS, " "), "<[^>]+>", " ")).otherwise(t)

    def number(p: Column) -> Column:
        code = F.regexp_extract(p, "[0-9]+", 0).cast("int")
        char = F.when((code > 0) & (code < 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(" ")
        return F.when(p.rlike("^&#[0-9]{1,7};$"), char).when(p.rlike("^&#[0-9]+;$"), " ").otherwise(p)

    def numbers(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit("(&#[0-9]+;|[^&]+|&)"), 1)
        return F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(parts, number), "")).otherwise(t)

    def named(t: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in V.ENTITIES.items() for x in pair])
        parts = F.regexp_extract_all(t, F.lit("((?i)&[a-z]+;|&#x[0-9a-f]+;|[^&]+|&)"), 1)
        text = F.transform(parts, lambda p: F.when(p.startswith("&") & (F.length(p) > 1), F.coalesce(F.try_element_at(known, F.lower(p)), F.lit(" "))).otherwise(p))
        return F.when(F.contains(t, F.lit("&")), F.array_join(text, "")).otherwise(t)

    def marks(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("[+")), F.regexp_replace(t, V.TRUNCATION, " ")).otherwise(t)

    def cut(t: Column) -> Column:
        return F.when(F.length(t) > longest, F.concat(F.rtrim(F.substring(t, 1, longest - 1)), F.lit("…"))).when(F.length(t) > 0, t)

    for step in (markup, numbers, named, marks):
        raw = _bound(raw, step)
    return _bound(F.trim(F.regexp_replace(raw, V.BLANKS, " ")), cut)


def strip_publisher(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, V.PUBLISHER, ""))


def dedup_key(title: Column) -> Column:
    """Lower case without publisher, accents and marks: a composed letter leaves its base letter, a mark of its own goes like any other."""
    plain = F.translate(F.lower(strip_publisher(title)), "".join(_MARKED), "".join(_MARKED.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", ""), r"\s+", " "))


def dedup_hash(title: Column) -> Column:
    return F.sha2(F.lower(F.trim(title)), 256)


def domain(url: Column) -> Column:
    """Host in lower case without www., null for what is no address."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def parse_time(text: Column) -> Column:
    """Compact (20260807T113000Z) or ISO time, as a UTC timestamp; null for anything else."""
    compact = F.try_to_timestamp(F.when(text.rlike(r"^\d{8}T\d{6}Z$"), text), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text).try_cast("timestamp")
    return F.coalesce(compact, iso)


def strict_number(text: Column) -> Column:
    """A plain number; blank, dots and words for "none" are null, never 0."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))


def redact(text: Column) -> Column:
    """Values of credential-like parameters and bearer tokens replaced, for logs."""
    for pattern in V.SECRETS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]")
    return text


def _masked(value: object, depth: int = 0) -> object:
    if depth > V.LOG_DEPTH:
        return "[max-depth]"
    if isinstance(value, str):
        for pattern in V.SECRETS:
            value = re.sub(pattern, r"\1[REDACTED]", value)
        return value
    if isinstance(value, list):
        return [_masked(v, depth + 1) for v in value[: V.LOG_ITEMS]]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if re.search(V.SECRET_KEYS, k) else _masked(v, depth + 1) for k, v in value.items()}
    return value


def redact_json(context: Column) -> Column:
    """A JSON context for logs: values under credential-like names replaced at any depth, texts redacted, long arrays and deep levels cut; what is no JSON is redacted as text."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(_masked(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return _masked(text)

        return texts.map(one)

    return masked(context)
