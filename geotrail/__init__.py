"""A PySpark-native analytics engine for trajectories, retrieval and position fusion."""
