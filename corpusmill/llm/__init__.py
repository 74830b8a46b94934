"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

WORD = r"[^\x20\x09-\x0D]+"
