"""Training-data operators: de-duplication, extraction, scoring, packing and formatting.

Nothing else in the library imports this subpackage.
"""
