"""Dataset preparation and classifier evaluation as Spark DataFrame jobs."""
