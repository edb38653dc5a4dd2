"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it; ``queries`` lists its entries for
the registry at the top of the repository.
"""
