"""Tidemark: engagement-panel analytics as composable Spark DataFrame jobs."""
