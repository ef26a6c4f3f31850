"""Spark-native operators for speech-translation data building and evaluation."""
