"""The same operators over arriving files, with Structured Streaming."""
