"""threadloom: document and conversation analytics as Spark jobs."""
