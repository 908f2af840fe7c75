"""Comparing what a stream has delivered with an expected table."""

from tessera.streaming.drain import drain, stream_equals

__all__ = ["drain", "stream_equals"]
