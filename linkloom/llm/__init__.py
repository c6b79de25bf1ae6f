"""Training-data operators: mixing, de-duplication, filters and extraction.

Nothing outside this folder imports it. ``queries.py`` lists the registered queries.
"""
