"""Part of the mossgrid analytics engine."""
