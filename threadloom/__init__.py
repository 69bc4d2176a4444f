"""Conversation-log analytics and search on Spark DataFrames."""
