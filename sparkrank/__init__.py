"""Ranking entities and selecting teams of them under constraints, on Spark."""
