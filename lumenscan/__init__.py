"""lumenscan: a PySpark-native audit engine for trees of text and code."""
