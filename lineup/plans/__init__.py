"""Plans: the registered queries, the tables they derive from the driver
tables, and the end-to-end feature / daily flows."""
