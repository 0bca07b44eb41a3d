"""Code-corpus analytics as Spark jobs."""
