"""Ledgerloom: a PySpark-native engine for statements, ledgers, record graphs and documents."""
