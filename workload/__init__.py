"""Check workload: catalog tables derived from the driver's test tables, queries over them, and their SQL twins."""
