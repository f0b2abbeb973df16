"""Group statistics over labelled measurement cubes, on Spark."""
