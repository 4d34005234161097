"""Training-data operators: dedup, decontamination, extraction, filtering, packing.

Nothing else in the library imports this subpackage; every module below it is
usable on its own with ordinary DataFrames.
"""
