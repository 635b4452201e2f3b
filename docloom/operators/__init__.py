"""Operators on documents, units and vectors."""
