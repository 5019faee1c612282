"""News and scenario scoring as column expressions; decimals where the stored score is decimal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def edges(pattern: str) -> str:
    """The pattern with ASCII word edges."""
    return re.sub(r"\\b", "(?![a-z0-9_])", re.sub(r"\\b(?=[(\w])", "(?<![a-z0-9_])", pattern))


def openings(pattern: str) -> list[tuple[str, str]]:
    """(literal start, rest) of each alternative of `\\b(a|b|c)...`; together they match what the pattern matches."""
    group = re.match(r"\\b(\((?:[^()]|\([^()]*\))*\))?", pattern)
    body, closing = (group[1][1:-1], pattern[group.end() :]) if group and group[1] else (pattern.removeprefix(r"\b"), "")
    out = []
    for choice in re.split(r"\|(?![^()]*\))", body):
        plain = re.match(r"[a-z0-9 ]*", choice)[0]
        if choice[len(plain) : len(plain) + 1] in ("?", "*", "{"):
            plain = plain[:-1]
        out.append((plain, edges(choice[len(plain) :] + closing)))
    return out


def by_start(alternatives: list[tuple[str, str]]) -> str:
    """One expression of all alternatives, in which common starts stand once; longer rests come first."""
    rests, below = [], {}
    for start, rest in alternatives:
        if start:
            below.setdefault(start[0], []).append((start[1:], rest))
        elif rest not in rests:
            rests.append(rest)
    parts = [re.escape(c) + by_start(more) for c, more in sorted(below.items())] + sorted(rests, key=len, reverse=True)
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def hits_of(text: str, patterns: list[str]) -> str:
    """SQL of where a text (in lower case) matches some pattern: the match and the characters that follow, each place's once.

    One search for all patterns, at the starts of words. A pattern without an open end is shorter than what follows, so each of them can
    be looked for at the start of these few strings, however long the text is.
    """
    found = by_start([x for p in dict.fromkeys(patterns) for x in openings(p)])
    return f"array_distinct(regexp_extract_all(concat(' ', {text}), r'\\W(?=({found}[\\s\\S]{{0,96}}))', 1))"


def terms(text: str) -> str:
    """SQL of the matches of all lexicons in a text in lower case; the functions below take them ready made."""
    lexicons = [V.CATALYSTS, V.BULLISH, V.BEARISH, V.SURPRISE, V.REGIONS]
    return hits_of(text, [row[0] for lexicon in lexicons for row in lexicon] + V.RELEVANCE + [V.SCHEDULED])


def over_hits(text: str, patterns: list[str], body: str, known: str | None = None) -> str:
    """SQL of `body` over h, the array of which patterns a text matches; the text is in lower case, word edges are ASCII.

    `known` are the matches that `terms` gives, where a column holds them. They are bound once, and all is inside lambdas, so no
    generated code grows with the number of patterns.
    """
    tests = ", ".join(f"exists(b, s -> rlike(s, r'^(?:{by_start(openings(p))})'))" for p in patterns)
    return f"element_at(transform(transform(array({known or hits_of(text, patterns)}), b -> array({tests})), h -> {body}), 1)"


def matches(text: str, pattern: str, known: str | None = None) -> str:
    """SQL of a match."""
    return over_hits(text, [pattern], "h[0]", known)


def weighted(text: str, lexicon: list[tuple[str, int]], known: str | None = None) -> Column:
    """Sum of the weights of the patterns that match."""
    return F.expr(over_hits(text, [p for p, _ in lexicon], " + ".join(f"if(h[{i}], {w}, 0)" for i, (_, w) in enumerate(lexicon)), known))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(F.floor(F.least(F.lit(high), F.greatest(F.lit(low), x)) * 100 + F.lit(0.5)) / 100)


def news_score(macro: Column, volatility: Column, reliability: Column, surprise: Column, duration: Column) -> Column:
    """Weighted score, rounded to two places in decimal arithmetic; null if any component is."""
    if abs(sum(map(float, V.WEIGHTS)) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    parts = zip(V.WEIGHTS, (macro, volatility, reliability, surprise, duration))
    total = sum((F.lit(w).cast("decimal(3,2)") * x.cast("decimal(6,2)") for w, x in parts), F.lit(0).cast("decimal(1,0)"))
    return F.round(total, 2).cast("decimal(6,2)")


def news_class(score: Column, incoming: Column | None = None) -> Column:
    """Tier of a rounded score; an incoming class other than noise stays."""
    tier = F.when(score >= V.CRITICAL, "critical").when(score >= V.MAJOR, "major").otherwise("noise")
    return tier if incoming is None else F.when(F.coalesce(incoming, F.lit("noise")) == "noise", tier).otherwise(incoming)


def news_action(score: Column) -> Column:
    return F.when(score >= V.CRITICAL, "RECALC_H1_H2").when(score >= V.MAJOR, "REEVALUATE_H3").otherwise("ARCHIVE_ONLY")


def risk_level(category: Column, score: Column) -> Column:
    level = F.when(score >= 80, "CRITICAL").when(score >= 65, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW")
    return F.when(category.isin("geopolitics", "financial_stability"), level)


def sentiment_label(sentiment: Column) -> Column:
    names = F.when(sentiment <= -0.6, "very_negative").when(sentiment <= -0.2, "negative").when(sentiment < 0.2, "neutral").when(sentiment < 0.6, "positive").otherwise("very_positive")
    return F.when(sentiment.isNotNull(), names)


def catalyst(text: str, known: str | None = None) -> Column:
    """struct(macro, volatility, duration, category, bias, cancelling, known, place) of all matching catalysts together.

    Numbers are maxima; the category is that of the first catalyst with the highest macro; the bias is the first there is;
    cancelling factors are the union in order. `known` is false where the default holds; `place` is the dominant catalyst's, null there.
    """
    def literal(x: object) -> str:
        return "cast(null as string)" if x is None else str(x) if isinstance(x, int) else '"' + x + '"'

    def rule(i: int, pattern: str, macro: int, volatility: int, duration: int, category: str, bias: str | None, cancelling: list[str]) -> str:
        return f"if(h[{i}], named_struct('rank', {-i}, 'macro', {macro}, 'volatility', {volatility}, 'duration', {duration}, 'category', {literal(category)}, 'bias', {literal(bias)}, 'cancelling', array({', '.join(map(literal, cancelling))})), null)"

    macro, volatility, duration, category, _, _ = V.DEFAULT_CATALYST
    found = "array_compact(array(" + ", ".join(rule(i, *r) for i, r in enumerate(V.CATALYSTS)) + "))"
    merged = f"""transform(array({found}), a -> named_struct('macro', coalesce(array_max(a.macro), {macro}), 'volatility', coalesce(array_max(a.volatility), {volatility}), 'duration', coalesce(array_max(a.duration), {duration}),
        'category', coalesce(array_max(transform(a, r -> named_struct('macro', r.macro, 'rank', r.rank, 'category', r.category))).category, {literal(category)}), 'bias', get(array_compact(a.bias), 0),
        'cancelling', array_distinct(flatten(a.cancelling)), 'known', size(a) > 0, 'place', -array_max(transform(a, r -> named_struct('macro', r.macro, 'rank', r.rank))).rank))[0]"""
    return F.expr(over_hits(text, [r[0] for r in V.CATALYSTS], merged, known))


def channel(place: Column) -> Column:
    """struct(channel, duration) of the dominant catalyst, by the `place` that `catalyst` gives; the default where none matches."""
    pair = lambda c: F.struct(F.lit(c[0]).alias("channel"), F.lit(c[1]).alias("duration"))
    return F.coalesce(F.get(F.array(*map(pair, V.CHANNELS)), place), pair(V.DEFAULT_CHANNEL))


def surprise(text: str, known: str | None = None) -> Column:
    """struct(score, proven): from a reported against an expected number, else from terms, else assumed."""
    # the pair is searched for once, where one of its words is there, and its numbers are taken from the match
    pair = lambda i: f"try_cast(replace(regexp_extract(m, r'{V.NUMBER_PAIR}', {i}), ',', '.') as double)"
    clamped = lambda x: f"if(isnan({x}), 0D, floor(least(100D, greatest(0D, {x})) * 100 + 0.5D) / 100)"
    words = " or ".join(f"contains({text}, '{w}')" for w in V.PAIR_WORDS)
    match = f"if({words}, regexp_extract({text}, r'{V.NUMBER_PAIR}', 0), '')"
    numbers = f"transform(array({match}), m -> named_struct('a', {pair(1)}, 'b', {pair(2)}))"
    change = f"transform({numbers}, n -> if(n.b <> 0, abs((n.a - n.b) / n.b) * 333, null))[0]"
    lexicon = over_hits(text, [p for p, _ in V.SURPRISE] + [V.SCHEDULED], "named_struct('terms', " + " + ".join(f"if(h[{i}], {w}, 0)" for i, (_, w) in enumerate(V.SURPRISE)) + f", 'base', if(h[{len(V.SURPRISE)}], 50D, 25D))", known)
    return F.expr(f"""transform(array(named_struct('change', {change}, 'found', {lexicon})), x -> named_struct(
        'score', case when x.change is not null then {clamped('x.change')} when x.found.terms > 0 then {clamped('cast(x.found.terms as double)')} else x.found.base end,
        'proven', x.change is not null or x.found.terms > 0))[0]""")


def direction(text: str, bias: Column, known: str | None = None) -> Column:
    """struct(direction, sentiment): net weight of terms, and its share with the sign turned."""
    bull = weighted(text, V.BULLISH, known) + F.when(bias == "bullish", 2).otherwise(0)
    bear = weighted(text, V.BEARISH, known) + F.when(bias == "bearish", 2).otherwise(0)
    net, total = bull - bear, bull + bear
    sentiment = F.when(total == 0, F.lit(0.0)).otherwise(F.floor(-net / total * 1000 + F.lit(0.5)) / 1000)
    return F.struct(F.when(net >= 2, "bullish").when(net <= -2, "bearish").otherwise("neutral").alias("direction"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sentiment)).alias("sentiment"))


def region(text: str, known: str | None = None) -> Column:
    return F.expr(over_hits(text, [p for p, _ in V.REGIONS], "case " + " ".join(f"when h[{i}] then '{name}'" for i, (_, name) in enumerate(V.REGIONS)) + " else 'GLOBAL' end", known))


def relevance(text: str, known: str | None = None) -> Column:
    """Number of term groups that match."""
    return weighted(text, [(p, 1) for p in V.RELEVANCE], known)


def quality(age_minutes: Column, has_body: Column, has_url: Column, has_domain: Column, reliability: Column) -> Column:
    fresh = F.when(age_minutes <= 15, F.lit(100.0)).otherwise(clamp(100 - (age_minutes - 15) / 1440 * 100))
    complete = F.lit(40) + F.when(has_body, 35).otherwise(0) + F.when(has_url, 15).otherwise(0) + F.when(has_domain, 10).otherwise(0)
    return clamp(fresh * 0.4 + complete * 0.3 + reliability * 0.3)


def freshness(age_seconds: Column, live: Column, stale: Column) -> Column:
    return F.when(age_seconds > stale, "UNAVAILABLE").when(age_seconds > live, "STALE").otherwise("LIVE")


def risk_reward(spot: Column, target: Column, invalidation: Column) -> Column:
    risk = F.abs(spot - invalidation)
    return F.when(risk >= 1e-9, F.abs(target - spot) / risk)


def confidence(value: Column) -> Column:
    """A share; numbers over 1 are percent; 0.5 where there is none."""
    x = F.coalesce(value, F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x)))


def session_label(hour: Column) -> Column:
    return _steps(hour, V.SESSIONS, lambda x, edge: x < edge, V.NO_SESSION)


def conviction(score: Column) -> Column:
    return F.when(score.isNull(), V.NO_SCORE).otherwise(_steps(score, V.CONVICTIONS, lambda x, edge: x >= edge, V.NO_CONVICTION))


def _steps(x: Column, steps: list[tuple[int, str]], fits, otherwise: str) -> Column:
    """The label of the first step that fits."""
    return F.coalesce(*[F.when(fits(x, edge), label) for edge, label in steps], F.lit(otherwise))
