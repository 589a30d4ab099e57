"""Fleet telemetry analytics on Spark: operators over landed database snapshots."""
