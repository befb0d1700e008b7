"""Personal data by weak supervision: labelers vote on spans, reliabilities are estimated, a
classifier decides.

Base spans (e-mail, IP, card, phone by exact rules) always stay. Looser patterns propose further
spans. Five labelers vote yes, no or nothing on every span: the strict shape (regex), lists of
known parts (gazetteer), words before it that speak for it and against it (context), and what
touches it. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; its posteriors train a naive Bayes classifier over kind, size and votes of a span,
and proposals that it accepts are added: obfuscated addresses, national phone numbers, social security
numbers, titled names and secrets (keys of known services, values assigned to a token, key or password,
long hexadecimal strings). Proposals behind a word such as serial, order or ISBN are refused.

All work on texts is column expressions. The driver receives counts of (votes, features)
patterns: at most ``3**5 * kinds * sizes`` rows, whatever the corpus.

Defined results:

* null or empty text: no spans;
* a proposal that touches a base span, or overlaps an earlier proposal that stays, is dropped;
* ties at the classifier's threshold are accepted; no proposals or an empty table: base spans only;
* repeated rows get equal spans, one row each; null ids are kept; extra columns are not read;
* whole texts of any length are read; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let

# Base rules. Possessive loops take the same text without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "person", "secret")
SPAN = "kind STRING, start INT, end INT"

# How common services begin their keys.
ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
NAMED = r"(?i:token|secret|key|password|passwd|pwd)"

# Proposals: kind, pattern, and a cheaper pattern that every text with a match has.
PROPOSALS = (
    ("email", r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}"
              r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63})+", r"[({\[ ]at[)}\] ].{1,70}(?:dot|\.)[)}\] ]?"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("person", r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
     r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame)\b"),
    ("secret", rf"(?<=[^A-Za-z0-9]|^)(?:{ISSUED})(?![A-Za-z0-9])|(?<={NAMED}[\"']? ?[=:] ?[\"']?)[A-Za-z0-9][A-Za-z0-9_+/.=-]{{7,}}+"
               r"|(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
     rf"{NAMED}[\"']? ?[=:]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|[0-9a-f]{{32}}"),
)
# Lists of the gazetteer labeler.
TOP_DOMAINS = "com org net edu gov io info biz de fr es it nl uk us ca eu ch at".split()
GIVEN_NAMES = (
    "James Mary John Linda Robert Patricia Michael Jennifer William Elizabeth David Susan Thomas Anna Peter Paul "
    "Hans Klaus Petra Pierre Marie Jean Claire Carlos Maria Juan Carmen Jose Lucia"
).split()
FOR_IT = r"(?i)(?:e-?mails?|contact|write to|reach|tel|phone|call|fax|mobile|ssn|social security|card|visa|address|host|server|name|dear|signed|token|secret|(?:api|access|private)[_ -]?key|password|passwd|pwd)\b[^\n]{0,12}$"
AGAINST_IT = r"(?i)(?:version|release|isbn|issn|order|invoice|serial|section|chapter|page|figure|part no|ref)\b[^\n]{0,8}$"
LABELERS = ("shape", "known", "context", "counter", "edges")
ITERATIONS = 25
ACCEPT = 0.5
PRIOR = 5.0  # spans
RIGHT = 10.0  # spans; a word before a span that speaks against it weighs more than its looks
WRONG = {"shape": 1.0, "known": 2.0, "context": 1.0, "counter": 0.05, "edges": 4.0}
BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Running totals of an ``ARRAY<INT>``, itself included; summed by blocks, so long ones stay cheap."""
    zero = F.lit(0)

    def total(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: a + x)

    def body(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(zero, F.floor((F.size(xs) - 1) / BLOCK).cast("int")),
            lambda b: total(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))),
        )

        def within(heads: Column) -> Column:
            return F.transform(xs, lambda x, i: (
                total(F.slice(heads, F.lit(1), F.floor(i / BLOCK).cast("int")))
                + total(F.slice(xs, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
            ))

        return let(blocks, within)

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(body(xs)))


def matches(text: Column, pattern: str, quick: Column) -> Column:
    """``ARRAY<STRUCT<start, end, hit>>``: leftmost non-overlapping matches, in order.

    ``quick`` is a cheap condition that holds for every text with a match.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0)))
        return let(prefix_sums(F.slice(steps, F.lit(1), F.size(hits))), lambda ends: F.transform(
            hits, lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"))
        ))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))
    return F.when(quick, found).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n)

    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """``ARRAY<STRUCT<kind, start, end, hit>>`` by the exact rules, by kind and then place."""
    def kept(kind: str, found: Column, good) -> Column:
        return F.transform(F.filter(found, lambda m: good(m["hit"])), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit")
        ))

    def small_parts(hit: Column) -> Column:
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)

    def is_card(hit: Column) -> Column:
        return let(digits(hit), lambda d: F.length(d).between(16, 19) & luhn(d))

    return F.concat(
        kept("email", matches(text, EMAIL, F.contains(text, F.lit("@"))), lambda h: F.lit(True)),
        kept("ip", matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), small_parts),
        kept("card", matches(text, CARD, text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")), is_card),
        kept("phone", matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda h: F.length(digits(h)).between(8, 15)),
    )


def thinned(spans: Column) -> Column:
    """Spans in order without those that begin before the end of the last one kept; block by block, so many stay cheap."""
    def block(at: Column, end: Column) -> Column:
        return F.aggregate(
            F.slice(spans, at * BLOCK + 1, F.lit(BLOCK)), F.struct(end.alias("end"), F.slice(spans, 1, 0).alias("kept")),
            lambda done, s: F.when(s["start"] < done["end"], done).otherwise(
                F.struct(s["end"].alias("end"), F.concat(done["kept"], F.array(s)).alias("kept"))),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")),
        F.struct(F.lit(0).alias("end"), F.slice(F.array(spans), 1, 0).alias("kept")),
        lambda done, at: let(block(at, done["end"]), lambda b: F.struct(
            b["end"].alias("end"), F.concat(done["kept"], F.array(b["kept"])).alias("kept"))),
        lambda done: F.flatten(done["kept"]),
    )


def proposed_spans(text: Column, base: Column) -> Column:
    """Spans of the looser patterns that touch no base span, by place; the earlier of two that meet."""
    def clear(m: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] <= m["end"]) & (m["start"] <= b["end"]))

    def named(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, clear), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["hit"].alias("hit")
        ))

    found = [named(kind, matches(text, pattern, text.rlike(quick))) for kind, pattern, quick in PROPOSALS]

    def free(spans: Column) -> Column:
        apart = F.forall(F.sequence(F.lit(1), F.size(spans)), lambda i: F.coalesce(F.get(spans, i - 1)["end"] <= F.get(spans, i)["start"], F.lit(True)))
        return F.when((F.size(spans) == 0) | apart, spans).otherwise(thinned(spans))

    return let(F.array_sort(F.concat(*found)), free)


def voted(text: Column, span: Column) -> Column:
    """Votes (1, -1 or 0 for none) and features of one span."""
    hit, kind = span["hit"], span["kind"]
    before = F.substring(text, F.greatest(span["start"] - 31, F.lit(1)), F.least(span["start"], F.lit(32)))
    after = F.substring(text, span["end"] + 1, F.lit(1))

    def by_kind(**values: Column) -> Column:
        return reduce(lambda out, k: F.when(kind == k, values[k]).otherwise(out), values, F.lit(0))

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, -1).when(yes, 1).otherwise(0)

    number = digits(hit)
    last = F.lower(F.regexp_extract(hit, "([A-Za-z]+)[^A-Za-z]*$", 1))
    odd, against = F.lit(False), before.rlike(AGAINST_IT)
    shape = by_kind(
        email=vote(hit.rlike(r"^[A-Za-z0-9._%+-]+(?:@| ?[(\[{]at[)\]}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]+)+$"), hit.rlike(r"[.] |\.\.")),
        ip=vote(hit.rlike(r"^(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"), hit.rlike(r"(?:^|\.)0[0-9]")),
        card=vote(hit.rlike(r"^[3-6]"), hit.rlike(r"^[01]")),
        phone=vote(hit.rlike(r"^(?:\+[0-9]|\([0-9]{3}\) )|^([0-9]{3})([ .-])[0-9]{3}\2[0-9]{4}$"), F.length(number) < 8),
        ssn=vote(hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), hit.rlike("^(?:000|666|9)")),
        person=vote(hit.rlike(r"^[^ ]+ \p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,})?$"), odd),
        # letters and digits change often in what a machine made; words and numbers are not secrets
        secret=vote(hit.rlike(rf"^(?:{ISSUED}|(?=[^A-Za-z]*+[A-Za-z][^0-9]*+[0-9])(?=[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z]).{{12,}})$"),
                    ~hit.rlike(f"^(?:{ISSUED})$") & (~hit.rlike("[0-9]") | ~hit.rlike("[A-Za-z]"))),
    )
    known = by_kind(
        email=vote(last.isin(*TOP_DOMAINS), F.length(last) < 2),
        ip=vote(~hit.rlike(r"^(?:0|255)\."), hit.rlike(r"^(?:0|255)\.")),
        card=vote(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), odd),
        phone=vote(hit.rlike(r"^\+[1-9]|^\(?[2-9][0-9]{2}\)?[ .-][2-9]"), hit.rlike(r"^\+0|^\(?[01]")),
        ssn=F.lit(0),
        person=vote(F.arrays_overlap(F.split(hit, " "), F.array(*map(F.lit, GIVEN_NAMES))), odd),
        secret=vote(hit.rlike(f"^(?:{ISSUED})$"), hit.rlike("(?i)example|changeme|placeholder|xxxx")),
    )
    return F.struct(
        # how numbers look is no evidence where a word before them says what else they are
        F.when(against & (shape > 0), 0).otherwise(shape).alias("shape"), F.when(against & (known > 0), 0).otherwise(known).alias("known"),
        F.when(before.rlike(FOR_IT), 1).otherwise(0).alias("context"),
        F.when(against, -1).otherwise(0).alias("counter"),
        vote((before == "") | before.rlike(r"[\s(<\[:;,=\"']$"), before.rlike(r"[\p{L}0-9.-]$") | after.rlike(r"[\p{L}0-9]")).alias("edges"),
        F.least(F.floor(F.length(hit) / 6), F.lit(7)).cast("int").alias("size"),
    )


FEATURES = ("kind", "size", *LABELERS)


def spans_of(documents: DataFrame, *keep: str) -> DataFrame:
    """``*keep``, ``base`` and ``proposed`` spans of ``documents.text``; each with votes and features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def judged(spans: Column, source: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), voted(source, s).alias("v")
        ))

    def both(t: Column) -> Column:
        return let(base_spans(t), lambda base: F.struct(
            judged(base, t).alias("base"), judged(proposed_spans(t, base), t).alias("proposed")
        ))

    return documents.select(*keep, let(text, both).alias("_s")).select(*keep, "_s.base", "_s.proposed")


def pattern_counts(spans: DataFrame) -> list[tuple[tuple[int, ...], tuple, int, int]]:
    """``(votes, features, count, count of proposals)`` over all spans."""
    def marked(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), s["v"].alias("v"), F.lit(int(name == "proposed")).alias("p")))

    each = spans.select(F.explode(F.concat(marked("base"), marked("proposed"))).alias("s"))
    columns = [F.col(f"s.v.{x}").alias(f"l_{x}") for x in LABELERS]
    columns += [(F.col("s.kind") if x == "kind" else F.col(f"s.v.{x}")).alias(f"f_{x}") for x in FEATURES]
    names = [f"l_{x}" for x in LABELERS] + [f"f_{x}" for x in FEATURES]
    grouped = each.select(*columns, "s.p").groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))
    k = len(LABELERS)
    return [(tuple(r[:k]), tuple(r[k:-2]), r[-2], r[-1]) for r in grouped.orderBy(*names).collect()]


def reliabilities(counts, iterations: int = ITERATIONS) -> tuple[list[float], dict]:
    """Posterior of every pattern, and ``{labeler: {class: {vote: probability}}}``, by EM.

    Labelers are independent given the class, both classes are as likely before any vote, and a
    labeler that does not vote says nothing: probabilities are among the spans it votes on. ``RIGHT``
    counts are added to the cells where a labeler is right and ``WRONG`` to those where it errs;
    the first beliefs follow from these alone.
    """
    def estimated(belief: list[float]) -> dict:
        table = {}
        for at, name in enumerate(LABELERS):
            cells = {y: {v: RIGHT if v == (1 if y else -1) else WRONG[name] for v in (-1, 1)} for y in (0, 1)}
            for b, (votes, _, n, *_) in zip(belief, counts):
                if votes[at]:
                    cells[1][votes[at]] += b * n
                    cells[0][votes[at]] += (1 - b) * n
            table[name] = {y: {v: c / sum(cells[y].values()) for v, c in cells[y].items()} for y in (0, 1)}
        return table

    def believed(table: dict) -> list[float]:
        odds = (sum(math.log(table[x][1][v] / table[x][0][v]) for x, v in zip(LABELERS, votes) if v) for votes, *_ in counts)
        return [1 / (1 + math.exp(-max(min(o, 50.0), -50.0))) for o in odds]

    table = estimated([])
    for _ in range(iterations):
        table = estimated(believed(table))
    return believed(table), table


def train(counts) -> tuple[float, dict[str, dict]]:
    """Bias and log-odds of feature values: naive Bayes on the estimated labels of proposals, both classes as likely.

    Base spans help to estimate labelers, but as they stay anyway they would only teach their own kinds.
    """
    proposed = [(b, features, n) for b, (_, features, _, n) in zip(reliabilities(counts)[0], counts) if n]
    if not proposed:
        return -1.0, {}
    total = sum(n for _, _, n in proposed)
    yes = sum(b * n for b, _, n in proposed)
    no = total - yes
    weights: dict[str, dict] = {}
    for at, name in enumerate(FEATURES):
        cells = defaultdict(lambda: [0.0, 0.0])
        for b, features, n in proposed:
            cells[features[at]][1] += b * n
            cells[features[at]][0] += (1 - b) * n
        # smoothed by what all spans look like: a rare value alone speaks for neither class
        weights[name] = {
            v: math.log((c[1] + PRIOR * sum(c) / total) / (yes + PRIOR)) - math.log((c[0] + PRIOR * sum(c) / total) / (no + PRIOR))
            for v, c in cells.items()
        }
    return 0.0, weights


def fit(spans: DataFrame) -> tuple[float, dict[str, dict]]:
    """Classifier learnt from all spans of a table made by ``spans_of``."""
    return train(pattern_counts(spans))


def accepted(model: tuple[float, dict[str, dict]], threshold: float = ACCEPT) -> Column:
    """``ARRAY<STRUCT<kind, start, end>>``: base spans and accepted proposals, by kind and place."""
    bias, weights = model

    def odds(s: Column) -> Column:
        total = F.lit(bias)
        for name, values in weights.items():
            own = s["kind"] if name == "kind" else s["v"][name]
            table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
            total = total + F.coalesce(F.element_at(table, own), F.lit(0.0))
        return total

    least = math.log(threshold / (1 - threshold))

    def ranked(spans: Column) -> Column:
        order = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair])
        return F.transform(spans, lambda s: F.struct(
            F.element_at(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
        ))

    chosen = F.filter("proposed", lambda s: odds(s) >= least) if weights else F.filter("proposed", lambda s: F.lit(False))
    return F.transform(F.array_sort(F.concat(ranked(F.col("base")), ranked(chosen))), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")
    ))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spans: DataFrame, model: tuple[float, dict[str, dict]]) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of a table made by ``spans_of``."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(accepted(model)).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with ``<KIND>`` in place of each span; spans that meet are one, named after the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(xs: Column) -> Column:
        heads = F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, F.lit(1), i), lambda y: y["end"] > x["start"]))

        def reach(hs: Column) -> Column:
            def end(x: Column, i: Column) -> Column:
                nxt = F.get(hs, i + 1)["start"]
                own = F.filter(xs, lambda y: (y["start"] >= x["start"]) & (nxt.isNull() | (y["start"] < nxt)))
                return F.array_max(F.transform(own, lambda y: y["end"]))

            return F.transform(hs, lambda x, i: F.struct(x["start"].alias("start"), end(x, i).alias("end"), x["kind"].alias("kind")))

        return let(heads, reach)

    def rebuilt(xs: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            done = F.coalesce(F.get(xs, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, done + 1, x["start"] - done), F.lit("<"), F.upper(x["kind"]), F.lit(">"))

        tail = F.substring(text, F.element_at(xs, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(xs, piece), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(let(ordered, merged), rebuilt))
