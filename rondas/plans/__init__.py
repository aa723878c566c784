"""Compositions of operators: the start screen, the views refreshed after a change, the query catalogue."""
