"""Cobordia: a Spark-native analytics engine for signals on cell complexes."""
