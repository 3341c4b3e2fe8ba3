"""Shop tables derived from the driver's test tables, the registered queries and their SQL."""
