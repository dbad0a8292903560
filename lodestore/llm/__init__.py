"""Training-data operators: mixing, sharding, dedup, scoring, tokenizing.

The subpackage stands alone: nothing else in the library imports it, and it can
be removed without touching the vector engine.  Every operator takes DataFrames
and returns DataFrames; ``queries`` applies each one to its whole table.
"""
