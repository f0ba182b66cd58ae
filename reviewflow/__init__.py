"""reviewflow: mail-review analytics as Spark jobs."""
