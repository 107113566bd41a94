"""Query plans: the catalog scenarios, operator queries with their SQL, layouts, and measurement."""
