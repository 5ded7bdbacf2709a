"""Operators of the media-manifest engine."""
