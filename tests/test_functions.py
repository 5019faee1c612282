"""Scalar rules against fixed vectors."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scoring, text

# Score components with the score and class that they must give.
SCORES = [
    ((80, 60, 90, 70, 50), "71.00", "major"), ((100, 90, 100, 80, 70), "89.50", "critical"), ((100,) * 5, "100.00", "critical"), ((0,) * 5, "0.00", "noise"), ((100, 90, 80, 100, 70), "90.50", "critical"),
    ((50,) * 5, "50.00", "noise"), ((90, 85, 95, 88, 60), "84.85", "critical"), ((12.34, 56.78, 90.12, 34.56, 78.9), "47.32", "noise"), ((99.99, 0, 0, 0, 0), "30.00", "noise"), ((63.2, 71.5, 48.8, 55.1, 90.4), "65.16", "major"),
    ((60,) * 5, "60.00", "major"), ((80,) * 5, "80.00", "critical"), ((79.99,) * 5, "79.99", "major"),
]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("parts,score,tier", SCORES)
def test_news_score_and_tier(spark, parts, score, tier):
    s = scoring.news_score(*[F.lit(Decimal(str(p))) for p in parts])
    row = one(spark, s, scoring.news_class(s))
    assert (row.c0, row.c1) == (Decimal(score), tier)


def test_score_of_a_missing_part_is_missing(spark):
    assert one(spark, scoring.news_score(F.lit(None), *[F.lit(50)] * 4)).c0 is None


def test_an_incoming_class_stays(spark):
    assert one(spark, scoring.news_class(F.lit(90), F.lit("minor"))).c0 == "minor"


def test_rounding_comes_before_the_tier(spark):
    s = scoring.news_score(*[F.lit(Decimal("79.99"))] * 4, F.lit(Decimal("80.03")))
    assert tuple(one(spark, s, scoring.news_class(s))) == (Decimal("80.00"), "critical")


@pytest.mark.parametrize("value,share", [(0.72, 0.72), (72.0, 0.72), (500.0, 1.0), (-5.0, 0.0), (None, 0.5)])
def test_confidence(spark, value, share):
    assert one(spark, scoring.confidence(F.lit(value).cast("double"))).c0 == pytest.approx(share)


@pytest.mark.parametrize("args,ratio", [((3400, 3450, 3380), 2.5), ((3400, 3450, 3400), None), ((3400, 3410, 3380), 0.5)])
def test_risk_reward(spark, args, ratio):
    assert one(spark, scoring.risk_reward(*[F.lit(float(a)) for a in args])).c0 == ratio


def test_words_have_ascii_edges(spark):
    found = one(spark, *[F.expr(scoring.matches(f"'{t}'", r"\b(fed)\b")) for t in ("the fed acts", "éfed", "federal", "fed_x", "x-fed.")])
    assert list(found) == [True, True, False, False, True]


def test_numbers_beat_terms_of_surprise(spark):
    row = one(spark, *[scoring.surprise(f"'{t}'") for t in ("cpi at 4,0% vs. 3.2% expected, unexpected", "unexpected shock", "cpi today", "nothing")])
    assert [(round(r.score, 2), r.proven) for r in row] == [(83.25, True), (30.0, True), (50.0, False), (25.0, False)]


def test_catalysts_take_maxima_and_the_first_of_the_highest(spark):
    c = one(spark, scoring.catalyst("'war and sanctions after the cpi'"), scoring.catalyst("'sunny'"))
    assert (c.c0.macro, c.c0.volatility, c.c0.duration, c.c0.category, c.c0.bias) == (95, 92, 88, "inflation", "bullish")
    assert c.c0.cancelling[0] == "réaction hawkish de la Fed" and len(c.c0.cancelling) == 6
    assert (c.c1.macro, c.c1.category, c.c1.bias, c.c1.known) == (25, "other", None, False)


def test_clean_text(spark):
    raw = "<script>x('</p>')</script><p>Tom &amp; &quot;Ann&quot; &#8217;s &lt;b&gt; &copy; \x07​ end [+23 chars]</p>"
    row = one(spark, text.clean_text(F.lit(raw), 100), text.clean_text(F.lit("<p> </p>"), 10), text.clean_text(F.lit("abcdefghij klm"), 11), text.clean_text(F.lit(None).cast("string"), 9))
    assert list(row) == ['Tom & "Ann" ’s <b> end', None, "abcdefghij…", None]


def test_keys_domains_times_and_numbers(spark):
    assert one(spark, text.dedup_key(F.lit("L'or bondit à 3 400 $ — Les Échos"))).c0 == "lor bondit a 3 400"
    assert one(spark, text.domain(F.lit("https://www.Reuters.com:443/a?b")), text.domain(F.lit("no address"))).asDict() == {"c0": "reuters.com", "c1": None}
    times = one(spark, *[F.date_format(text.parse_time(F.lit(t)), "yyyy-MM-dd HH:mm:ss") for t in ("20260807T113000Z", "2026-08-07T11:30:00Z", "2026-08-07", "soon")])
    assert list(times) == ["2026-08-07 11:30:00", "2026-08-07 11:30:00", "2026-08-07 00:00:00", None]
    assert list(one(spark, *[text.strict_number(F.lit(t)) for t in ("4.21", " -1e2 ", ".", "", "N/A", "null", "1,5")])) == [4.21, -100.0, None, None, None, None, None]
    assert one(spark, text.redact(F.lit("GET /q?apikey=abc&x=1 Bearer tok.en"))).c0 == "GET /q?apikey=[REDACTED]&x=1 Bearer [REDACTED]"


def test_a_composed_letter_leaves_its_base(spark):
    titles = {"Tiếng Việt ḍ": "tieng viet d", "Ångström Ünïcode — X": "angstrom unicode x", "étude": "etude", "ß æ ø 日本 1²": "1", "ǆ ﬁ Ⅷ": ""}
    df = spark.createDataFrame(list(titles), "string").select("value", text.dedup_key(F.col("value")).alias("k"))
    assert {r.value: " ".join(r.k.split()) for r in df.collect()} == {t: " ".join(k.split()) for t, k in titles.items()}


def test_cleaning_in_one_pass(spark):
    cases = {
        "<p>a &amp;lt; b</p>": "a &lt; b", "&#38;lt; &#x41; &bogus; &LT;&euro;5": "< <€5", "x<script>alert('&amp;')</SCRIPT>y<style a=1>s</style>z": "x y z", "cut [+2317 chars]": "cut", "a & b &c": "a & b &c",
        "&#0;&#1114111;&#65;&#99999999999;B": "A B", "  \t​ ": None, "a" * 25: "a" * 19 + "…", "word " * 6: "word word word word…",
    }
    df = spark.createDataFrame(list(cases), "string").select("value", text.clean_text(F.col("value"), 20).alias("c"))
    assert {r.value: r.c and " ".join(r.c.split()) for r in df.collect()} == {k: v and " ".join(v.split()) for k, v in cases.items()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") <= 4


def test_names_of_credentials_are_redacted_at_any_depth(spark):
    import json

    deep = {"a": 1}
    for _ in range(9):
        deep = {"d": deep}
    context = {"user": "u", "API_KEY": "x", "list": [{"Authorization": {"v": 1}}, "https://h/?token=abc&b=1", None, 2.5, True], "long": list(range(80)), "deep": deep}
    got = json.loads(one(spark, text.redact_json(F.lit(json.dumps(context)))).c0)
    assert got["API_KEY"] == "[REDACTED]" and got["list"] == [{"Authorization": "[REDACTED]"}, "https://h/?token=[REDACTED]&b=1", None, 2.5, True] and got["user"] == "u"
    assert got["long"] == list(range(50)) and "max-depth" in json.dumps(got["deep"]) and '"a"' not in json.dumps(got["deep"])
    assert one(spark, text.redact_json(F.lit("no json, key=abc"))).c0 == "no json, key=[REDACTED]" and one(spark, text.redact_json(F.lit(None).cast("string"))).c0 is None
