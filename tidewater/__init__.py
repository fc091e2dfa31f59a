"""tidewater: a PySpark-native analytics engine for tick-level event data."""
