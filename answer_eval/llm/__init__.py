"""Training-data operators: one module per operator, ``plans`` for the queries.

Nothing else in the library imports this subpackage.
"""
