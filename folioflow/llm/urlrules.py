"""URL filters: rules are found by their rarest literal token, and only those run as regular expressions.

Two kinds of rules stand in one table ``rules(rule, allow, site)``:

* a *site* rule is a host and the beginning of a path (``example.net/en/``); it fits that host and
  its subdomains, where the path begins with its own;
* a *pattern* is a filter line: ``*`` stands for anything, ``^`` for a separator (anything but
  letters, digits and ``_-.%``) or the end, ``||`` anchors a host or a parent of it, ``|`` the begin
  or the end of the URL. Letters A-Z are compared in lower case.

Every rule is kept under one literal token (``[a-z0-9%]+``, whole in whatever the rule matches):
the one that the fewest URLs of the corpus hold. A URL fetches the rules under its own tokens and
runs the regular expressions of those. Rules without a whole token are fetched by every URL.

Of the site rules that match, the longest decides (of equally long ones the allowing, then the
greatest text); else an allowing pattern, else a blocking one; else the URL is allowed.

Lists of up to ``INLINE`` rules become part of the expression: judging is then a projection, without
any shuffle. Longer lists are joined: distinct URLs by token, verdicts back by URL, heavy tokens and
URLs split.

Defined results: a null URL, and one without ``://``, has an empty host and path; a null URL is judged
as an empty one. Null, empty and repeated rules count once or not at all. Repeated pages are judged
each. Empty tables give empty results. Other columns are left out of the report, whatever they are
called; ``judged`` keeps them and adds ``host, path, winner``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import let
from folioflow.llm.common import LOWER, UPPER
from folioflow.operators.shared import attach, materialise

INLINE = 500  # rules: as literals of one expression they stay below a few hundred kB
ALLOW, BLOCK = "allow", "block"
EVERY = ""  # the token of rules that have none of their own
TOKEN = "[a-z0-9%]+"

# Fixed values of the query: the site rules of its contract.
SITES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))

# Fixed values of the query: what is no prose, or the same prose under another address. @@ allows.
PATTERNS = (
    "^utm_source=", "^utm_campaign=", "^utm_medium=", "^gclid=", "^fbclid=", "^sessionid=", "^phpsessid=", "^jsessionid=",
    "@@||blog.*^utm_source=feed^", "^replytocom=", "^print=1^", "^format=pdf^", "^sort=*&page=", "^page=*&ref=",
    "/ads/", "/adserver/", "/banners/", "||doubleclick.net^", "||adservice.", "||ads.", "||track.", "||pixel.",
    "/wp-login.php", "/wp-admin/", "/cgi-bin/", "/login|", "/login?", "/signup|", "/register|", "/cart|", "/checkout/",
    "/search?", "^q=*^start=", "/tag/", "/tags/", "/calendar/*/*/", "/feed/|", "/rss|", "/sitemap*.xml|",
    ".zip|", ".exe|", ".dmg|", ".iso|", ".tar.gz|", ".jpg|", ".jpeg|", ".png|", ".gif|", ".mp3|", ".mp4|", ".css|", ".js|",
    "||porn", "/xxx/", "^xxx^", "/casino/", "||casino.", "/viagra", "/payday-loan", "||bit.ly/", "||t.co/", "||localhost^",
    "/404.html|", "/error?code=", "@@/robots.txt|", "@@||example.org^*/about/",
)

SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER), F.regexp_extract(whole, parts, 2)


def tokens(lowered: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit(EVERY)), F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))))


def compiled(rules: DataFrame) -> DataFrame:
    """``rule, allow, site, weight, regex, tokens`` of ``rules(rule, allow, site)``, each once."""
    lowered = F.translate("rule", UPPER, LOWER)
    core = F.when(F.col("site"), F.col("rule")).otherwise(F.regexp_replace(lowered, r"^\|\|?|\|$", ""))
    literal = F.regexp_replace(core, r"([\\.\[\]{}()+?$|])", r"\\$1")
    wild = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    opened = F.when(lowered.startswith("||"), r"^[^:/?#]*://(?:[^/?#]*\.)?").when(lowered.startswith("|"), "^").otherwise("")
    closed = F.when(lowered.endswith("|"), r"\z").otherwise("")
    quoted = F.regexp_replace(F.col("rule"), r"([\\.\[\]{}()+?$|*^])", r"\\$1")
    regex = F.when(F.col("site"), F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted)).otherwise(F.concat(F.lit("(?s)"), opened, wild, closed))
    # what stands beside the open end of a rule may lengthen its last token
    begin = F.when(F.col("site") | lowered.startswith("|"), "|").otherwise("*")
    end = F.when(~F.col("site") & lowered.endswith("|"), "|").otherwise("*")
    inside = F.when(F.col("site"), F.translate(lowered, "*", "_")).otherwise(core)
    whole = rf"(?<![a-z0-9%*])({TOKEN})(?![a-z0-9%*])"
    once = rules.where("rule IS NOT NULL AND rule <> ''").groupBy("rule", "site").agg(F.bool_or("allow").alias("allow"))
    return once.select(
        "rule", "allow", "site", F.when(F.col("site"), F.length("rule")).otherwise(0).alias("weight"), regex.alias("regex"),
        F.array_distinct(F.regexp_extract_all(F.concat(begin, inside, end), F.lit(whole), F.lit(1))).alias("tokens"),
    )


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``token, rules``: every rule of ``compiled`` under the one of its tokens that the fewest URLs hold."""
    each = rules.select("rule", "allow", "site", "weight", "regex", F.explode_outer("tokens").alias("token"))
    found = each.join(counts, "token", "left").groupBy("rule", "allow", "site", "weight", "regex").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    packed = F.struct("site", "weight", "allow", "rule", "regex")
    return found.groupBy(F.coalesce("rarest.token", F.lit(EVERY)).alias("token")).agg(F.sort_array(F.collect_list(packed)).alias("rules"))


def winner(found: Column, lowered: Column, address: Column) -> Column:
    """``STRUCT<site, weight, allow, rule>`` of the deciding rule among the fetched ones, or null."""
    hits = F.filter(found, lambda r: F.rlike(F.when(r["site"], address).otherwise(lowered), r["regex"]))
    return F.array_max(F.transform(hits, lambda r: F.struct(r["site"], r["weight"], r["allow"], r["rule"])))


def _literal(value) -> Column:
    """Index entries as one literal expression."""
    return F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in ("site", "weight", "allow", "rule", "regex")]) for r in value])


def judged(pages: DataFrame, rules: DataFrame, inline: int = INLINE) -> DataFrame:
    """``pages`` with ``host, path, winner``; columns of these names are replaced."""
    known = materialise(compiled(rules), "rules")
    host, path = host_and_path(F.col("url"))
    url = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    address = F.concat(host, path)
    small = known.count() <= inline
    held = tokens(url).alias("tokens")
    if small:
        wanted = known.select(F.explode("tokens").alias("token")).distinct()
        counts = pages.select(F.explode(held).alias("token")).join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        index = {r["token"]: r["rules"] for r in indexed(known, counts).collect()}  # at most ``inline`` rules
        shape = "array<struct<site:boolean,weight:int,allow:boolean,rule:string,regex:string>>"
        if not index:
            found = F.array().cast(shape)
        else:
            listed = F.array(*[F.lit(t) for t in index])
            lookup = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), _literal(rs))])
            found = F.flatten(F.transform(F.array_intersect(tokens(url), listed), lambda t: F.try_element_at(lookup, t)))
        return pages.withColumns({"host": host, "path": path, "winner": winner(found, url, address)})
    urls = materialise(pages.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count(F.lit(1)).alias("copies")), "urls")
    exploded = urls.select("url", F.explode(held).alias("token"))
    counts = materialise(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    index = materialise(indexed(known, counts).join(counts, "token", "left").na.fill(1, ["n"]), "index")
    # tokens that no rule is kept under leave before anything is shuffled with the rules
    fetched = attach(exploded, index, "token", "n").where("rules IS NOT NULL")
    best = fetched.withColumn("winner", winner(F.col("rules"), url, address)).where("winner IS NOT NULL")
    decided = materialise(best.groupBy("url").agg(F.max("winner").alias("winner")).join(urls, "url"), "decided")
    rest = pages.withColumns({"_url": F.coalesce("url", F.lit("")), "host": host, "path": path}).drop("winner")
    return attach(rest, decided.withColumnRenamed("url", "_url"), "_url", "copies").drop("_url")


def report(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, matched``: ``rule`` is a site rule, ``matched`` any."""
    w = F.col("winner")
    return pages.select(
        "page_id", "host", "path", F.when(w["site"], w["rule"]).alias("rule"),
        F.when(F.coalesce(w["allow"], F.lit(True)), ALLOW).otherwise(BLOCK).alias("verdict"), w["rule"].alias("matched"),
    )


def rule_table(spark: SparkSession, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """``rules`` of site rules ``(rule, verdict)`` and pattern lines."""
    rows = [(r, v == ALLOW, True) for r, v in sites] + [(p.removeprefix("@@"), p.startswith("@@"), False) for p in patterns]
    return spark.createDataFrame(rows, "rule STRING, allow BOOLEAN, site BOOLEAN")


def oracle(sites=SITES, patterns=PATTERNS) -> str:
    """SQL that runs every rule on every URL."""
    def regex(p: str) -> str:
        body = p.removeprefix("||").removeprefix("|").removesuffix("|").lower()
        out = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c, c if c.isalnum() or c in "_%=&/-" else "\\" + c) for c in body)
        return "(?s)" + (r"^[^:/?#]*://(?:[^/?#]*\.)?" if p.startswith("||") else "^" if p.startswith("|") else "") + out + (r"\z" if p.endswith("|") else "")

    lines = [(p.removeprefix("@@"), p.startswith("@@")) for p in patterns]
    values = ", ".join([f"('{r}', {str(v == ALLOW).lower()}, true, '', {len(r)})" for r, v in sites] + [f"('{p}', {str(a).lower()}, false, '{regex(p)}', 0)" for p, a in lines])
    return f"""
WITH r(rule, allow, site, re, weight) AS (VALUES {values}),
cut AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM cut),
h AS (
  SELECT n, max({{'site': site, 'weight': weight, 'allow': allow, 'rule': rule}}) AS w FROM p JOIN r ON CASE WHEN site
    THEN (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
    ELSE regexp_matches(url, re) END GROUP BY n)
SELECT page_id, host, path, CASE WHEN w.site THEN w.rule END AS rule, CASE WHEN coalesce(w.allow, true) THEN '{ALLOW}' ELSE '{BLOCK}' END AS verdict,
  w.rule AS matched
FROM p LEFT JOIN h USING (n)
"""
