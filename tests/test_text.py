import html
import re

import pytest
from pyspark.sql import functions as F

from driftloom.functions import clock, text

TOKENS = [
    ("Rain AGAIN in Porto", ["rain", "again", "in", "porto"]),
    ("@mara_7 saw (https://example.org/a?b=1 or WWW.EXAMPLE.ORG yesterday", ["saw", "or", "yesterday"]),
    ("#FirstSnow of the year", ["firstsnow", "of", "the", "year"]),
    ("tea &lt; coffee &amp; cake &#33;", ["tea", "coffee", "cake"]),
    ("noooo wayyyyy!!!!", ["noo", "wayy"]),
    ("it's what we'd said, isn't it", ["it's", "what", "we'd", "said", "isn't", "it"]),
    ("@a @b www.only.links", []),
    ("@cafe\u0301 ok", ["ok"]),
    ("a1b2 2nd", ["a1b2", "2nd"]),
]
ENTITIES = ["&amp;gt; &lt;b&gt; &#65; &#x41; &#128; &#0; &#xD800; &#1114112; &notit; &amp &ampfoo;",
            "&unknown; &#99999999999999; &#x; & &nbsp;x &copy2 &#1; &#11; &#65534;", "", "&hearts;&fjlig; &#x1F600; &#13;"]


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t, _ in TOKENS], "s string")
    got = [r.t for r in df.select(text.tokens(F.col("s")).alias("t")).collect()]
    assert got == [t for _, t in TOKENS]


def test_squeeze_keeps_two(spark):
    df = spark.createDataFrame([("aaaah, brrrrr... hmmm",)], "s string")
    assert df.select(text.clean(F.col("s"))).first()[0] == "aah, brr.. hmm"


def test_a_mention_ends_at_a_combining_mark(spark):
    df = spark.createDataFrame([("x @cafe\u0301s y",)], "s string")
    assert df.select(text.drop_mentions(F.col("s"))).first()[0] == re.sub(r"@\w+", " ", "x @cafe\u0301s y")


def test_entities_follow_html(spark):
    df = spark.createDataFrame([(t,) for t in ENTITIES], "s string")
    got = [r.u for r in df.select(text.unescape_html(F.col("s")).alias("u")).collect()]
    assert got == [html.unescape(t) for t in ENTITIES]


def test_token_bag_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    got = [[tuple(x) for x in r.b] for r in df.select(text.token_bag(F.col("t")).alias("b")).collect()]
    assert got == [[("a", 1), ("b", 2)], []]


def test_clock(spark):
    df = spark.createDataFrame([("Mon Apr 06 22:19:45 PDT 2009",)], "d string")
    row = df.select(clock.corpus_timestamp(F.col("d")).alias("ts")).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s"), clock.model_time(F.col("ts"), F.lit(7)).alias("h")).first()
    assert row.s == "2009-04-06 22:19:45" and abs(row.h - 344182 - 19 / 60 - 45 / 3600) < 1e-9
    with pytest.raises(ValueError):
        clock.model_time(F.lit(0), F.lit(0), "minute")
