"""Registered queries: a Spark callable and, where SQL can express it, the same as text."""
