"""Monthly capacity-risk analytics on Spark: DataFrame in, DataFrame out."""
