"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing else in ``docloom`` imports this subpackage; it can be removed as a whole.
"""
