"""Clausewright streaming."""
