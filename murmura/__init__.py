"""murmura: chat-message enrichment, search and data preparation on Spark."""
