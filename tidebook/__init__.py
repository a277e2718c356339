"""Tick-level market analytics and trade evaluation as Spark jobs."""
