"""tilequarry: image bytes, rows and pixels as queryable Spark tables."""
