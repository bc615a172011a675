"""Structured Streaming forms of the analytics and of incremental graph updates.

Lateness: events up to LATENESS behind the newest count, later ones are dropped.
"""
