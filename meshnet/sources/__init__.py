"""Scans of exports and solver output, and deck writers."""
