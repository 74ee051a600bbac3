"""Spark-native engine for auditing labelled corpora and evaluating classifiers."""
