"""Spark-native operators for document pipelines and the services that run them."""
