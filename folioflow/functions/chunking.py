"""Cut a text into pieces of at most ``size`` characters, at sentence ends where possible.

The rule is a greedy packing: tokens are sentences, or the words of a sentence that is too long,
whose first word always opens a chunk. Tokens are marked off in the text and one regular
expression then packs them: each match is the longest stretch of whole tokens that still fits,
or a single word that never will. Its cost is linear in the text. A text that contains the marks
themselves takes a fold over tokens, which needs no marks and is slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let, strip, words

# A space behind one of . ! ? ends a sentence; a bar is a cut of its own.
SENTENCE_CUT = r"(?<=[.!?]) |\|"
END_MARK, OPEN_MARK = "\x01", "\x02"


def chunk_text(text: Column, size: int) -> Column:
    """``ARRAY<STRING>``; a text that fits is returned untouched as one chunk."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_pack_sentences(text, size))


def _pack_sentences(text: Column, size: int) -> Column:
    # \G ties each match to the end of the last one, so matching stops at the first
    # sentence that does not fit; then the matches do not cover the text.
    stretch = rf"(?s)\G(.{{0,{size}}})(?:{SENTENCE_CUT})"
    stretches = F.regexp_extract_all(F.concat(text, F.lit("|")), F.lit(stretch), F.lit(1))

    def checked(found: Column) -> Column:
        covered = F.aggregate(found, F.lit(0), lambda n, s: n + F.length(s) + 1)
        clean = F.transform(found, lambda s: strip(F.replace(s, F.lit("|"), F.lit(" "))))
        marked = text.rlike(f"[{END_MARK}{OPEN_MARK}]")
        return (
            F.when(covered == F.length(text) + 1, clean)
            .when(marked, fold_tokens(text, size))
            .otherwise(_pack_marked(text, size))
        )

    return let(stretches, checked)


def _pack_marked(text: Column, size: int) -> Column:
    """Every token followed by a mark, over-long sentences opened by another one, then one expression."""
    end, opening = F.lit(END_MARK), F.lit(OPEN_MARK)

    def parts(sentence: Column) -> Column:
        return (
            F.when(F.length(sentence) <= size, F.concat(sentence, end))
            .when(strip(sentence) == "", opening)
            .otherwise(F.concat(opening, F.array_join(words(sentence), END_MARK), end))
        )

    tokens = F.array_join(F.transform(F.split(text, SENTENCE_CUT), parts), "")
    stretch = rf"\G{OPEN_MARK}*+([^{OPEN_MARK}]{{0,{size}}}(?={END_MARK})|[^{OPEN_MARK}{END_MARK}]++){END_MARK}"
    found = F.regexp_extract_all(tokens, F.lit(stretch), F.lit(1))
    return F.transform(found, lambda s: strip(F.replace(s, end, F.lit(" "))))


def fold_tokens(text: Column, size: int) -> Column:
    """The same packing without marks, by a fold that carries integers; for texts that hold the marks."""
    return _pack(_tokens(text, size), size)


def _tokens(text: Column, size: int) -> Column:
    """Sentences, with over-long ones replaced by their words.

    ``fresh`` marks the first word of an over-long sentence, which always starts a chunk.
    An over-long sentence of white space only leaves a null token behind.
    """

    def token(value: Column, fresh: Column) -> Column:
        return F.struct(value.alias("value"), F.length(value).alias("width"), fresh.alias("fresh"))

    def parts(sentence: Column) -> Column:
        whole = F.array(token(sentence, F.lit(False)))
        blank = F.array(token(F.lit(None).cast("string"), F.lit(True)))
        in_words = F.transform(words(sentence), lambda w, i: token(w, i == 0))
        return (
            F.when(F.length(sentence) <= size, whole)
            .when(strip(sentence) == "", blank)
            .otherwise(in_words)
        )

    return F.flatten(F.transform(F.split(text, SENTENCE_CUT), parts))


def _pack(tokens: Column, size: int) -> Column:
    no_cuts = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("used"), no_cuts.alias("cuts"))

    def step(state: Column, token: Column) -> Column:
        opens = (state["seen"] == 0) | token["fresh"] | (state["used"] + token["width"] > size)
        width = F.coalesce(token["width"] + 1, F.lit(0))
        return F.struct(
            (state["seen"] + 1).alias("seen"),
            F.when(opens, width).otherwise(state["used"] + width).alias("used"),
            F.when(opens, F.array_append(state["cuts"], state["seen"])).otherwise(state["cuts"]).alias("cuts"),
        )

    def assemble(bound: Column) -> Column:
        toks, cuts = bound["tokens"], bound["cuts"]

        def group(first: Column, i: Column) -> Column:
            after = F.coalesce(F.get(cuts, i + 1), F.size(toks))
            return F.transform(F.slice(toks, first + 1, after - first), lambda t: t["value"])

        groups = F.filter(F.transform(cuts, group), lambda g: F.exists(g, lambda v: v.isNotNull()))
        return F.transform(groups, lambda g: strip(F.array_join(g, " ")))

    def fold(toks: Column) -> Column:
        cuts = F.aggregate(toks, start, step, lambda s: s["cuts"])
        return let(F.struct(toks.alias("tokens"), cuts.alias("cuts")), assemble)

    return let(tokens, fold)
