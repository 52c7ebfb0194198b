"""Training-data pipeline operators: dedup, packing, scans, classifiers, search.

Self-contained: nothing outside this subpackage imports it.
"""
