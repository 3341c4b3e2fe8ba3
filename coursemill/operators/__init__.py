"""Reusable table operators: numbering, merging, joining, browsing, deleting, checking."""
