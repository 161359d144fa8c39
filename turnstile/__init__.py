"""Visit, capacity and revenue analytics for lift-served venues, on Spark."""
