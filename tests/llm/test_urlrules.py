import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.llm import urlrules

URLS = [
    "http://a.net/x", "https://net/", "http://a.net", "http://example.net/en/9?x#y", "http://Deep.EXAMPLE.net/en/a", "http://example.net/EN/a",
    "http://example.com/de/", "http://myexample.com/de/", "http://a.org/fr/b", "http://org/fr/", "http://a.org/frx", "no scheme.net/", "", None,
    "x?u=http://a.net/y", "http://a.com/?u=http://b.net/", "http://a.net:80/x", "http://u@net/x", "http://a.net\n/x", "http://a.com/ads/1", "http://a.com/bads/1",
    "http://a.com/login", "http://a.com/login2", "http://a.com/LOGIN", "http://ads.a.com/", "http://a.com/ads.b", "http://a.com/x.zip", "http://a.com/x.zip?y",
    "http://blog.a.com/?utm_source=feed", "http://a.com/?utm_source=feed", "http://a.com/robots.txt", "http://a.net/robots.txt", "http://porn.com/robots.txt",
    "http://a.com/calendar/1/2/", "http://a.com/%61ds/", "http://x.com/é?q=1&start=2", "http://a.com/" + "a/" * 50_000 + "ads/",
]


def by_sql(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    return sorted(con.execute(urlrules.oracle()).fetchall(), key=repr)


def judged(spark, pages, rules, **settings):
    df = spark.createDataFrame([(*p, 1, "x", "y") for p in pages], "page_id BIGINT, url STRING, tokens INT, winner STRING, host STRING")
    return sorted(map(tuple, urlrules.report(urlrules.judged(df, rules, **settings)).collect()), key=repr)


@pytest.mark.parametrize("inline", [500, 0])
def test_every_rule_on_every_url_gives_the_same(spark, inline):
    rng = random.Random(3)
    parts = ["ads", "net", "en", "login", "porn", "a", "utm_source=feed", ".zip", "org", "fr", "example"]
    made = ["http://" + ".".join(rng.choices(parts, k=2)) + "/" + rng.choice("/?&.").join(rng.choices(parts, k=4)) for _ in range(300)]
    pages = [(i, u) for i, u in enumerate([*URLS, *made, *["http://a.net/ads/"] * 300])] + [(None, "http://a.net/"), (1, "http://a.net/x")]
    got = judged(spark, pages, urlrules.rule_table(spark), inline=inline)
    assert got == by_sql(pages)
    assert {r[4] for r in got} == {"allow", "block"} and len({r[5] for r in got}) > 10


def test_site_rules_of_the_contract(spark):
    rows = {p[0]: r for p, r in zip(enumerate(URLS), sorted(judged(spark, list(enumerate(URLS)), urlrules.rule_table(spark)), key=lambda r: r[0]))}
    assert rows[0][1:5] == ("a.net", "/x", "net/", "block")
    assert rows[2][3] is None, "a url without path does not begin with a rule's"
    assert rows[3][3:5] == ("example.net/en/", "allow") and rows[4][1:4] == ("deep.example.net", "/en/a", "example.net/en/")
    assert rows[5][3] == "net/" and rows[6][3] == "example.com/de/" and rows[7][3] is None
    assert rows[8][3:5] == rows[9][3:5] == ("org/fr/", "allow") and rows[10][3] is None
    assert rows[11][1:4] == rows[12][1:4] == rows[13][1:4] == ("", "", None) and rows[13][4] == "allow"
    assert rows[14][1:4] == ("a.net", "/y", "net/") and rows[16][3] is None


def test_rules_are_kept_under_their_rarest_token(spark):
    rules = spark.createDataFrame(
        [("/common/rare/", False, False), ("part*whole/", False, False), ("||", False, False), (None, True, False), ("", True, False),
         ("open", False, False), ("|http://x", True, False), ("/common/rare/", True, False), ("a.b/c", False, True)], "rule STRING, allow BOOLEAN, site BOOLEAN")
    known = urlrules.compiled(rules)
    assert {r["rule"]: sorted(r["tokens"]) for r in known.collect()} == {
        "/common/rare/": ["common", "rare"], "part*whole/": [], "||": [], "open": [], "|http://x": ["http"], "a.b/c": ["a", "b"]}
    counts = spark.createDataFrame([("common", 9), ("rare", 2), ("http", 99), ("a", 5), ("b", 5)], "token STRING, n BIGINT")
    index = {r["token"]: [x["rule"] for x in r["rules"]] for r in urlrules.indexed(known, counts).collect()}
    assert index.pop("") and index == {"rare": ["/common/rare/"], "http": ["|http://x"], "a": ["a.b/c"]}
    assert known.where("rule = '/common/rare/'").first()["allow"], "of repeated rules the allowing one counts"


def test_empty_tables(spark):
    none = urlrules.rule_table(spark).where(F.lit(False))
    for inline in (500, 0, -1):
        assert judged(spark, [], urlrules.rule_table(spark), inline=inline) == []
        assert judged(spark, [(1, "http://a.net/x")], none, inline=inline) == [(1, "a.net", "/x", None, "allow", None)]
