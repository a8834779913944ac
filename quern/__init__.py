"""quern: a PySpark-native analytics engine for labelled sequence data."""
