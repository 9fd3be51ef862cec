"""Scans and sinks."""

from cachelens.sources.tables import (embedding_table, nest_conversations, scan_benchmark_results,
                                      scan_conversations, scan_queries, write_benchmark_files,
                                      write_results_json, write_table)

__all__ = ["embedding_table", "nest_conversations", "scan_benchmark_results", "scan_conversations",
           "scan_queries", "write_benchmark_files", "write_results_json", "write_table"]
