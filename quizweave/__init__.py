"""Spark-native linking of exam questions with lecture pages, and analytics around it."""
