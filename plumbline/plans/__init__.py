"""Plans: whole reports, and the catalogue of queries with their SQL."""
