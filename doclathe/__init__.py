"""Document ETL on Spark: parse, map, clean, validate, de-duplicate, triage."""

__version__ = "0.1.0"
