"""Sources of the media-manifest engine."""
