"""Coverage analytics for publishers, expressed as Spark DataFrame plans."""
