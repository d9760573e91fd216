"""DataFrame operators over detections, walls, junctions, masks and text regions."""
