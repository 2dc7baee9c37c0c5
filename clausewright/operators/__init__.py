"""Clausewright operators."""
