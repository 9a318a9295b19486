"""waymark: Spark jobs that build, clean, bind, rank and evaluate a large catalog of HTTP API endpoints."""
