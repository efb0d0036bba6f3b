"""boxlens: detection-evaluation analytics as Spark DataFrame operators."""
