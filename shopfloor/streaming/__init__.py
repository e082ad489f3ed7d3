"""Structured Streaming forms of the live behaviour."""

from shopfloor.streaming.runner import read_stream_table, run_stream  # noqa: F401
