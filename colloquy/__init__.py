"""Conversation archives as Spark tables: sources, cleaning, identity, search, topics, profiling and reports."""
