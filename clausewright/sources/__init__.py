"""Clausewright sources."""
