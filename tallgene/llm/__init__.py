"""Operators for preparing training text: archives, joins on shingles, tokens, mixing, redaction, classifiers, neighbour search.

Nothing else in the library imports this package.
"""
