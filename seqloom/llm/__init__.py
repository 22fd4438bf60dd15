"""Operators of a training-data pipeline; each module states the results of its edge cases."""
