"""Query operators over normalised detections."""
