"""Operators on cells, faces, clusters and reactor networks."""
