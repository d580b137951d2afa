"""tessella: Spark-native analytics for panels of series, written as DataFrame plans."""
