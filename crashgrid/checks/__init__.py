"""Fixture views over the test tables, registered queries and their reference SQL."""
