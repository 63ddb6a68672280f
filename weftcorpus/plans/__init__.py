"""Compositions of operators and their command lines."""
