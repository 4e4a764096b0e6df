"""Reports over collected database-server telemetry, as Spark DataFrame operators."""
