"""Character-level text analytics on Spark: text tables in, model and score tables out."""
