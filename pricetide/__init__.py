"""Price tracking catalog on Spark: extraction, matching, change capture and catalog queries."""
