"""Point-in-time signal validation on Spark."""
