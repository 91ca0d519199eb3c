"""The rule language, and its compilation to Spark columns."""
