"""Inputs: raw detections, geographic features, org registry, published results."""
