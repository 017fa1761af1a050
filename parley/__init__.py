"""Conversation analytics as Spark DataFrame-to-DataFrame operators."""
