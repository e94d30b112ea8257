"""Whole analyses composed from the operators, and the registered queries."""
