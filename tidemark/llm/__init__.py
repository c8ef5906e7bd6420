"""Operators of a large training-data pipeline. Self-contained: the rest of the package never imports this."""
