"""Usage analytics for assistant session logs, expressed as Spark DataFrame plans."""
