"""Pipelines of named steps, and the evidence that queries derive from plain tables."""
