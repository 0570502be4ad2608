"""Compares two snapshots of a structured artifact, and prepares training text, on Spark."""
