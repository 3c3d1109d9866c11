"""neurotab: Spark DataFrame operators for experimental-science tables."""
