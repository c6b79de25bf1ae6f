"""Registered queries: operators composed over the given tables, each with its SQL or None."""

from linkloom.plans import learning, spatial

QUERIES = spatial.QUERIES | learning.QUERIES
