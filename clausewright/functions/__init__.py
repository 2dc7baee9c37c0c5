"""Clausewright functions."""
