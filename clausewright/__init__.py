"""Clausewright: a PySpark-native analytics engine for regulatory-compliance data."""
