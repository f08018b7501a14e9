"""Work-activity analytics as Spark DataFrame queries."""
