"""PySpark engine for time-ordered, multi-topic interaction logs."""
