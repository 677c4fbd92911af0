"""Compositions of operators: end-to-end jobs and the registered queries."""
