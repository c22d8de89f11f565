"""Spark-native text reuse and formulaic-language analytics.

The core holds the reference pipeline (sources, functions, operators, plans,
streaming).  ``charterloom.llm`` holds the training-data operators; nothing in
the core imports it.
"""

__version__ = "0.1.0"
