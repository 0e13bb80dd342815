"""Queries over the domain: posts, topics, histories, runs and sources."""
