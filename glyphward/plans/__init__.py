"""Composition of operators into plans, and where plans keep intermediate tables."""
