"""Relational and array operators over masks, instances and detections."""
