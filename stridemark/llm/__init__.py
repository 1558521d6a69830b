"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for ``__spark_entry__``."""
