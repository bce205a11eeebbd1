"""Queries, their inputs and their SQL."""
