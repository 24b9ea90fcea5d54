"""galley: market and text analytics for publishing data, written as Spark DataFrame plans."""
