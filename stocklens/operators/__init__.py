"""Reusable DataFrame operators: selection, joins, ordering, prefix sums."""
