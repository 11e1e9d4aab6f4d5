"""Training-data pipeline operators (mixing, quality, dedup, formats).

Nothing else in the library imports this subpackage.
"""
