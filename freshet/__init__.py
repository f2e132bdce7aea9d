"""Flood and landslide analytics expressed as Spark DataFrame transforms."""
