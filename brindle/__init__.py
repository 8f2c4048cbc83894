"""brindle: a PySpark-native engine for turning raw text and event data into daily signals."""
