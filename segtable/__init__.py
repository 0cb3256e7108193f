"""A PySpark-native engine for segmented tables of nullable byte strings."""
