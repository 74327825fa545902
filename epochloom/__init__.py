"""Gap-aware epoch analytics on Spark: DataFrame, window and keyed-state plans."""
