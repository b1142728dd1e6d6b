"""Compositions of the operators, inputs derived from the given tables, and the registered queries."""
