"""PySpark-native analytics for short-form social video: terms, routing, clusters, lifts."""
