"""Relational operators over files, commits, edges, findings and clone windows."""
