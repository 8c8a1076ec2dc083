"""Spark-native table operators for geospatial screening and survey analysis."""
