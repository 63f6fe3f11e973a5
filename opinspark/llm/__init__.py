"""Operators for building training corpora: search, scoring, dedup, mixing, sharding.

The subpackage stands alone: nothing outside of it imports it, and it imports
nothing from the rest of the library.
"""
