"""Functions of the media-manifest engine."""
