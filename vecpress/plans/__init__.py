"""Whole jobs: from tables to tables, as a user calls them."""
