"""comarca: regional-panel analytics as plain Spark DataFrame transformations."""
