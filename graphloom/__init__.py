"""graphloom: a PySpark-native engine for multimodal knowledge graphs."""
