"""Structured Streaming operators."""

from cachelens.streaming.lookup_stream import file_stream, hit_rate_by_hour, run_updates_to_table, tag_by_key, tag_by_vector

__all__ = ["file_stream", "hit_rate_by_hour", "run_updates_to_table", "tag_by_key", "tag_by_vector"]
