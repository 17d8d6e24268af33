"""Street-name analytics on Spark: normalized names, joined streets, spatial statistics."""
