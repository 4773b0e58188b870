"""Spelling quality for German text at corpus scale, as Spark jobs."""
