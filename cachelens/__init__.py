"""cachelens: embedding and query-log analytics expressed as Spark DataFrame jobs.

Every public operator is a function ``DataFrame(s) -> DataFrame`` that builds a lazy
logical plan; nothing is collected unless a size bound has been checked first.
"""

from cachelens.session import get_spark, load_table, checkpoint_dir, materialize

__all__ = ["get_spark", "load_table", "checkpoint_dir", "materialize"]
