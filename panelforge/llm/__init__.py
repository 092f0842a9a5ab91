"""Operators for preparing language-model training text, one module each, and their registered queries."""
