"""Compositions of operators and their registered queries."""
