"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])

SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bbox", BBOX),
    T.StructField("font", T.StringType()),
    T.StructField("size", T.DoubleType()),
])

LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])

# type 0 is text; every other type is left alone.
LAYOUT_BLOCK = T.StructType([
    T.StructField("type", T.IntegerType()),
    T.StructField("lines", T.ArrayType(LINE)),
])

# One row per page: what a page decoder returns. Ordinals are array positions.
LAYOUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("n_pages", T.IntegerType()),
    T.StructField("blocks", T.ArrayType(LAYOUT_BLOCK)),
])

RAW_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

BENCHMARK = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

CHAT_REQUEST = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])

CHAT_RESPONSE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]))),
])

# One line of the progress stream; unused fields are null and so left out of the JSON.
PROGRESS_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("percent", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("pdf_b64", T.StringType()),
    T.StructField("message", T.StringType()),
])

ANSWERS = T.StructType([
    T.StructField("chunk_key", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("copies", T.LongType()),
    T.StructField("answer", T.StringType()),
    T.StructField("error", T.StringType()),
])

# Answers as they are kept: the text to use, and why the source had to stand in.
ANSWERED = T.StructType([
    T.StructField("chunk_key", T.StringType()),
    T.StructField("copies", T.LongType()),
    T.StructField("translated", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])
