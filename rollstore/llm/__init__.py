"""Training-data operators: deduplication, scans, search, scoring, mixing and tokenisation.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing of the library.  Every operator is a function from DataFrames
to a DataFrame; ``registry`` holds the thin queries over the test tables.
"""
