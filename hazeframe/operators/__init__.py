"""Relational operators and estimators."""
