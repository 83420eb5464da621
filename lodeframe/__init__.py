"""Spark-native analytics over document corpora and the assessments made from them."""
