"""Whole plans: the queries with their SQL, and the improvement loop."""
