"""Event-history and grouped time-series analytics expressed as Spark DataFrame plans."""
