"""Fixed translations of phrases: the leftmost, then longest term of a glossary wins at every place.

A text is words (letters and digits) and what stands between them. A term matches as whole words, in
any case, where only white space stands between its words. Every stretch of words of a length that
terms have is looked up in the glossary (of small glossaries only those whose words stand at the same places
in some term): a join on the phrase, whose small side Spark broadcasts if its size allows and whose frequent phrases are split otherwise. The hits of a text come back to it as one
list, as long as the text at most; overlaps are settled there, and everything that no term covers stays
as it was, between the translations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import WHITESPACE_RUN, let
from folioflow.operators.shared import attach, materialise

WORD = r"[\p{L}\p{N}]+"
MOST_WORDS = 8  # of a term
MOST_TERMS = 2_000  # whose words are looked for before the join; with more of them the join alone decides


def phrase(text: Column) -> Column:
    """The words of a term in lower case, with single spaces; null without any."""
    return F.nullif(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " "), F.lit(""))


def terms_of(glossary: DataFrame) -> DataFrame:
    """``phrase, n_words, translation`` of ``glossary(term, translation)``: each phrase once, with the smallest of its translations.

    Terms without words or translation, and those of more than ``MOST_WORDS`` words, are left out.
    """
    rows = glossary.where("translation IS NOT NULL").select(phrase(F.col("term")).alias("phrase"), "translation").where("phrase IS NOT NULL")
    once = rows.groupBy("phrase").agg(F.min("translation").alias("translation"))
    return once.withColumn("n_words", F.size(F.split("phrase", " "))).where(F.col("n_words") <= MOST_WORDS)


def _pieces(text: Column) -> Column:
    """``ARRAY<STRING>`` gap 0, word 0, gap 1, word 1, …: gap 0 may be empty, the last one is left out if it is."""
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}|[^{WORD[1:-2]}]+"), F.lit(0))
    return F.when(text.rlike(rf"\A{WORD}"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def _stretches(pieces: Column, lengths: Sequence[int], phrases: Sequence[str] | None) -> Column:
    """``ARRAY<STRUCT<at, n, phrase>>`` of all stretches of ``lengths`` words with nothing but white space between them.

    If ``phrases`` are given, of those only whose every word is that of some phrase of the length at its place.
    """
    blank = rf"\A(?:{WHITESPACE_RUN})\z"
    split = [p.split(" ") for p in phrases or []]

    def from_place(i: Column) -> Column:
        def of_length(n: int) -> Column:
            words = [F.get(pieces, i + 2 * j) for j in range(n)]
            fits = words[-1].isNotNull()
            if phrases is not None:
                # most words stand in no term: the expression ends at the first of them
                for word, known in zip(words, zip(*[w for w in split if len(w) == n])):
                    fits &= word.isin(*sorted(set(known)))
            for j in range(n - 1):
                fits &= F.get(pieces, i + 2 * j + 1).rlike(blank)
            at = F.shiftright(i - 1, 1)
            return F.when(fits, F.struct(at.alias("at"), F.lit(n).alias("n"), F.concat_ws(" ", *words).alias("phrase")))

        return F.array_compact(F.array(*[of_length(n) for n in lengths]))

    if phrases is None:
        places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    else:
        first = sorted({w[0] for w in split})
        places = F.array_compact(F.transform(pieces, lambda w, i: F.when(w.isin(*first), i)))
    return F.flatten(F.transform(places, from_place))


def _settled(hits: Column) -> Column:
    """Of the hits, by place and longest first, those that begin behind the one taken before."""
    def take(acc: Column, hit: Column) -> Column:
        free = hit["at"] >= acc["reach"]
        return F.when(free, F.struct((hit["at"] + hit["n"]).alias("reach"), F.concat(acc["taken"], F.array(hit)).alias("taken"))).otherwise(acc)

    kind = "array<struct<at:int,shorter:int,n:int,translation:string>>"
    return F.aggregate(hits, F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("taken")), take)["taken"]


def _rebuilt(text: Column, taken: Column) -> Column:
    """The text with translations in place of what they cover."""
    def put(pieces: Column) -> Column:
        # from the gap behind one hit to the gap before the next
        between = lambda a, b: F.array_join(F.slice(pieces, 2 * a + 1, 2 * (b - a) + 1), "")
        end = lambda i: F.when(i < 0, 0).otherwise(F.get(taken, i)["at"] + F.get(taken, i)["n"])
        heads = F.transform(taken, lambda hit, i: F.concat(between(end(i - 1), hit["at"]), hit["translation"]))
        return F.concat(F.array_join(heads, ""), between(end(F.size(taken) - 1), F.floor(F.size(pieces) / 2).cast("int")))

    return let(_pieces(text), put)


def apply_glossary(texts: DataFrame, glossary: DataFrame, on: Sequence[str]) -> DataFrame:
    """``texts`` (a written table) with ``answer``, the text with all terms replaced, and ``n_terms``.

    ``on`` identifies a row. Texts should be chunks: settling overlaps costs the square of a text's hits.
    A null text has a null answer.
    """
    terms = materialise(terms_of(glossary), "terms")
    lengths = [r["n_words"] for r in terms.select("n_words").distinct().orderBy("n_words").collect()]
    if not lengths:
        return texts.withColumn("answer", F.col("text")).withColumn("n_terms", F.lit(0))
    phrases = [r["phrase"] for r in terms.select("phrase").limit(MOST_TERMS + 1).collect()]
    found = let(_pieces(F.lower("text")), lambda p: _stretches(p, lengths, phrases if len(phrases) <= MOST_TERMS else None))
    each = texts.where("text IS NOT NULL").select(*on, F.explode(found).alias("s")).select(*on, "s.*")
    # stretches are made once and leave at once unless they are terms; what is frequent among the rest is known then
    known = materialise(each.join(terms.select("phrase"), "phrase", "left_semi"), "stretches")
    counts = known.groupBy("phrase").agg(F.count(F.lit(1)).alias("copies"))
    lookup = materialise(terms.join(counts, "phrase").select("phrase", "translation", "copies"), "lookup")
    found = attach(known, lookup, "phrase", "copies")
    hit = F.struct("at", (-F.col("n")).alias("shorter"), "n", "translation")
    hits = found.groupBy(*on).agg(_settled(F.array_sort(F.collect_list(hit))).alias("taken"))
    joined = texts.join(hits, list(on), "left")
    answer = F.when(F.col("taken").isNull(), F.col("text")).otherwise(_rebuilt(F.col("text"), F.col("taken")))
    return joined.withColumns({"answer": answer, "n_terms": F.coalesce(F.size("taken"), F.lit(0))}).drop("taken")
