"""Streaming of the media-manifest engine."""
