"""driftlog: analytics over partitioned, offset-addressed event logs, on Spark."""
