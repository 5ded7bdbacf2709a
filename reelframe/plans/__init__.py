"""Plans of the media-manifest engine."""
