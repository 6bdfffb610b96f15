"""Light-curve analytics on Spark."""
