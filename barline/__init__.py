"""barline: a Spark-native analytics engine for OHLCV bar data."""
