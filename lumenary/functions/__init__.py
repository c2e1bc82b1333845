"""Part of the media-library engine."""
