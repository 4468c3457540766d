"""Registered queries and their SQL oracles, by topic."""
