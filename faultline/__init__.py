"""faultline: incident analytics over service telemetry, written as Spark DataFrame operators."""
