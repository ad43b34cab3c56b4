"""rillflow: water-network sensor analytics as Spark DataFrame plans."""
