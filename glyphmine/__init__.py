"""Code-knowledge analytics on Spark: scan, index, resolve and navigate source snapshots."""
