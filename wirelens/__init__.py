"""wirelens: Spark-native analytics for news and event feeds."""
