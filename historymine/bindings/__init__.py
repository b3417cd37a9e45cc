"""The engine bound to the test tables: views, queries and their SQL."""
