"""Operators for preparing training corpora, one module for each. Nothing outside this package imports it."""
