"""Plans over the tables of an archive, and the catalogue of queries."""
