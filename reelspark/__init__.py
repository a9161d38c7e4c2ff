"""Match-footage analytics on Spark: DataFrame operators over many videos at once."""
