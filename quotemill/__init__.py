"""Daily price analytics as Spark DataFrame jobs: clean, fit, forecast, score, look up."""
