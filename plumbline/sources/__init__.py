"""Sources: source trees, Git history, and the tables of a folder."""
