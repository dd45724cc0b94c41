"""Spark jobs that grade and rank trading engines from their order streams."""
