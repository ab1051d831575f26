"""PySpark-native analytics over document collections and the facts extracted from them."""
