"""Operators for preparing text training data. Nothing outside this folder imports it."""
