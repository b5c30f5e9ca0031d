"""Operators for preparing text for language models; nothing outside this package imports it."""
