"""Queries registered for checking, and the SQL that answers the same."""
