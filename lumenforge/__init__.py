"""Analytics over weakly supervised corpora as Spark DataFrame, SQL and streaming operators."""
