"""Neighbour tables that grow with a stream of vectors."""
