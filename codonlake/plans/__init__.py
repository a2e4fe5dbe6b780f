"""Jobs that chain the operators, and the queries over the given tables."""
