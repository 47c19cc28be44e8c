"""Part of the rangeloom engine."""
