"""Versioned, content-addressed analytics on PySpark: table states, diffs, merges, logs, fleets and claims as DataFrame queries."""
