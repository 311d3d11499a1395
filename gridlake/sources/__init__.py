"""Readers that turn pages, text and service JSON into grid rows."""
