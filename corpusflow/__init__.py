"""corpusflow: Spark-native analytics for labelled text corpora and their
change over time.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column
functions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(registered queries with DuckDB oracle SQL), ``streaming`` (Structured
Streaming twins).
"""

__version__ = "0.1.0"
