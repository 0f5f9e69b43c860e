"""Operators of a training-data pipeline over the corpus tables.

One module per operator; ``catalog.py`` registers their queries.  Nothing else
in the library imports this subpackage.
"""
