"""Quality rules: count rules, then a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed word unigrams and bigrams are estimated from whole tables: one from
trusted documents, one from all. A document's score is the mean log ratio of its n-grams, so
length does not matter; every document at or above the threshold stays. All of it is column
expressions and one small aggregate per multinomial (``buckets`` rows, whatever the corpus).

Defined results:

* null or blank text: no words, all counts 0, score 0, ``base_failed``, not kept;
* texts of any length are read whole; ties at the threshold are kept;
* repeated rows are judged alike, one row each; null ids are judged like any other;
* empty corpus or no trusted document: all ratios 0, so the count rules decide alone;
* extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let
from folioflow.llm.common import SPACE, words

BUCKETS = 10_000
MAX_TRUSTED = 50_000  # labelled rows that are learnt from
PRIOR = 10.0  # counts per bucket
THRESHOLD = -0.06
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"  # fixed value


def ngram_buckets(tokens: Column, buckets: int) -> Column:
    """``ARRAY<BIGINT>``: one bucket per word and per pair of neighbouring words."""
    def all_of(ws: Column) -> Column:
        single = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
        pairs = F.transform(
            F.slice(ws, 2, F.size(ws)), lambda w, i: F.pmod(F.xxhash64(F.get(ws, i), w), F.lit(buckets))
        )
        return F.concat(single, pairs)

    return let(tokens, all_of)


def bucket_counts(texts: DataFrame, buckets: int) -> dict[bool, dict[int, int]]:
    """Counts by bucket over all rows of ``texts(text, trusted)``, of trusted rows and of others.

    At most ``2 * buckets`` rows reach the driver.
    """
    grams = texts.select("trusted", F.explode(ngram_buckets(words(F.col("text")), buckets)).alias("bucket"))
    out: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in grams.groupBy("trusted", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[row["trusted"]][row["bucket"]] = row["n"]
    return out


def log_ratios(target: dict[int, int], raw: dict[int, int], buckets: int) -> list[float]:
    """``ln p_target - ln p_raw`` per bucket.

    The raw multinomial is smoothed by half a count, the target's by ``PRIOR`` counts per bucket
    dealt out as the raw one has them, so that a bucket with little evidence has a ratio near 0.
    """
    if not target or not raw:
        return [0.0] * buckets
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), PRIOR * buckets
    out = []
    for b in range(buckets):
        p_raw = (raw.get(b, 0) + 0.5) / (n_raw + 0.5 * buckets)
        out.append(math.log((target.get(b, 0) + prior * p_raw) / (n_target + prior)) - math.log(p_raw))
    return out


def fit(documents: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, most: int = MAX_TRUSTED) -> list[float]:
    """Log ratios learnt from all of ``documents(doc_id, text)`` and the trusted part of it.

    Of more than ``most`` trusted ids a sample of about that number is learnt from, chosen by the
    hash of the id: their table is then small enough to travel to the texts. Texts are read
    once and stay where they are.
    """
    ids = trusted_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    n = ids.count()
    if n > most:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit((1 << 30) * most // n))
    marked = documents.select("doc_id", "text").join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left")
    counts = bucket_counts(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), buckets)
    target, raw = counts[True], dict(counts[False])
    for bucket, count in target.items():
        raw[bucket] = raw.get(bucket, 0) + count
    return log_ratios(target, raw, buckets)


def ratio_score(tokens: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; 0 without any."""
    # read as one constant by the optimiser
    values = F.split(F.lit(",".join(repr(r) for r in ratios)), ",").cast("array<double>")

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(values, b.cast("int")))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    return let(ngram_buckets(tokens, len(ratios)), mean)


def repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more, the first included."""
    def covered(starts: Column) -> Column:
        # every window reaches to the next repeated window at most
        reach = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    def located(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def repeated(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce(
                (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])),
                (i > 0) & (x["h"] == F.get(s, i - 1)["h"]),
            ))
            return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

        # sorting bare numbers is cheap and settles most texts
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(placed, repeated)
        )

    def windows(ws: Column) -> Column:
        inner = [lambda i, k=k: F.get(ws, i + k) for k in range(width - 1)]
        return F.transform(F.slice(ws, width, F.size(ws)), lambda w, i: F.xxhash64(*[get(i) for get in inner], w))

    return let(tokens, lambda ws: F.when(F.size(ws) < width, F.lit(0).cast("bigint")).otherwise(let(windows(ws), located)))


def measures(documents: DataFrame, ratios: list[float]) -> DataFrame:
    """``doc_id``, the base counts and ``score``, row by row and without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    tokens = words(F.col("text"))

    def from_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
            ratio_score(ws, ratios).alias("score"),
        )

    return documents.select(
        "doc_id",
        let(tokens, from_words).alias("w"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score")


def judge(measured: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
