"""Jobs composed of several operators, and the queries over the driver tables."""
