"""Feeds and pages as tables."""
