"""Operators for preparing training data: ten numbered operators and their queries."""
