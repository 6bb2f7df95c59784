"""geoloom: a Spark-first analytics engine for geospatial and environmental data."""
