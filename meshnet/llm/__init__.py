"""Operators that prepare training text: each module holds one, with its query and SQL."""
