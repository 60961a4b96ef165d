"""brindle: market analytics as Spark DataFrame plans."""
