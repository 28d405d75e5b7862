"""velarium: retrieval, graph and corpus analytics expressed as plain Spark jobs."""
