"""Markup to text, as column expressions: what is a tag, what is silent, what a character reference stands for."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import WHITESPACE_RUN, let, strip

# A tag begins with a letter; a ">" between quotes of an attribute does not end it.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TAG = rf"(?is)</?[a-z]{ATTRIBUTES}>"
LINE_BREAK = rf"(?is)</?br(?=[\s/>]){ATTRIBUTES}>"
# Markup that carries no text of its own, unclosed up to the end.
SILENT = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<[!?][^>]*(?:>|\z)"
    rf"|</?[a-z]{ATTRIBUTES}\z"
)
BLOCKS = (
    "address|article|aside|blockquote|body|caption|center|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|h[1-6]|head|header|hgroup|hr|html|legend|li|listing|main|menu|nav|noscript|ol|optgroup|option|p|plaintext|pre|"
    "search|section|select|summary|table|tbody|td|template|textarea|tfoot|th|thead|title|tr|ul|xmp"
)
EDGE = rf"(?is)<(/?)({BLOCKS})(?=[\s/>]){ATTRIBUTES}>"

REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# Names come from the standard's table; numbers 128 to 159 mean what they mean in code page 1252.
NAMES = {name: text for name, text in html5.items()} | {
    f"#{n}": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))  # valid without semicolon
REPLACEMENT = "�"


def _numbered(code: Column, known: Column) -> Column:
    """The character of a number; what no document may hold is left out or replaced."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    low = code.bitwiseAND(0xFFFF)
    void = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | low.isin(0xFFFE, 0xFFFF)
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(bad, REPLACEMENT).when(code.between(128, 159), F.try_element_at(known, F.concat(F.lit("#"), code.cast("string")))).when(
        void, "").otherwise(char)


def references(text: Column) -> Column:
    """``text`` with its character references, named and numeric, put into characters.

    A name without its semicolon is looked up by its longest beginning that the standard allows so;
    what is no reference stays as it is.
    """
    known = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")
    opened = F.array(*[F.lit(n) for n in OPEN_NAMES])

    def meaning(ref: Column) -> Column:
        name = F.substring(ref, F.lit(2), F.length(ref))
        digits = F.regexp_replace(name, "^#[xX]?|;$", "")
        hexed = F.lower(F.left(name, F.lit(2))) == "#x"
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        code = F.when(F.length(short) > 8, F.lit(None)).when(hexed, F.conv(short, 16, 10).cast("bigint")).otherwise(short.try_cast("bigint"))
        begin = F.get(F.filter(opened, lambda n: F.startswith(name, n)), F.lit(0))
        by_name = F.coalesce(F.try_element_at(known, name), F.concat(
            F.try_element_at(known, begin), F.substring(name, F.length(begin) + 1, F.length(name))), ref)
        return F.when(F.startswith(name, F.lit("#")), _numbered(code, known)).otherwise(by_name)

    def joined(refs: Column) -> Column:
        pieces = F.split(text, REFERENCE, -1)
        meant = F.concat(F.transform(refs, meaning), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(pieces.alias("a"), meant.alias("b")), lambda x: F.concat(x["a"], x["b"])), "")

    return F.when(F.contains(text, F.lit("&")), let(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), joined)).otherwise(text)


def plain(markup: Column) -> Column:
    """The text of a piece of markup without block elements: line breaks are spaces, other tags nothing."""
    bare = F.regexp_replace(F.regexp_replace(markup, LINE_BREAK, " "), TAG, "")
    return let(bare, lambda t: strip(F.regexp_replace(references(t), WHITESPACE_RUN, " ")))
