"""Chat requests and responses as JSON columns, for translators that run outside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import strip
from folioflow.schemas import CHAT_RESPONSE

INSTRUCTION = (
    "Act as a translator from {source} to {target}. Answer with the translation and nothing else. "
    "Copy numbers, symbols, code, file paths, links, contact details, names and bracketed placeholders "
    "unchanged, keep the formatting, and add or leave out nothing."
)


def instruction(source_lang: str, target_lang: str) -> str:
    return INSTRUCTION.format(source=source_lang, target=target_lang)


def request_json(text: Column, model: str, source_lang: str, target_lang: str) -> Column:
    """The request body for one chunk."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = message("system", F.lit(instruction(source_lang, target_lang)))
    user = message("user", F.concat(F.lit("Text to translate: "), text))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(system, user).alias("messages")))


def response_text(body: Column) -> Column:
    """The first choice, stripped; null for a malformed, missing or blank answer."""
    parsed = F.from_json(body, CHAT_RESPONSE)
    content = F.get(parsed["choices"], F.lit(0))["message"]["content"]
    return F.nullif(strip(content), F.lit(""))
