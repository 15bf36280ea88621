"""Foliomill: a Spark-native document intelligence engine."""
