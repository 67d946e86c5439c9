"""Whole analyses put together from operators."""
