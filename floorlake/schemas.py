"""Fixed schemas of the engine's tables; ``image_id`` is the key of every join and group."""

from __future__ import annotations

IMAGES = "image_id long, width double, height double, mm_per_px double"
DETECTIONS = "image_id long, det_id long, class_id int, score double, y1 double, x1 double, y2 double, x2 double"
MASK_RUNS = "image_id long, det_id long, class_id int, y long, x_start long, x_end long"
WALLS = "image_id long, wall_seq int, det_id long, sx double, sy double, ex double, ey double, thickness_avg double"
JUNCTIONS = "image_id long, j_seq int, x double, y double"
PATH_POINTS = "path_id long, pos int, x double, y double"
SEGMENTS = "image_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"
TEXT_REGIONS = "image_id long, region_id long, text string, x1 double, y1 double, x2 double, y2 double, confidence double, method string"
CLASS_NAMES = {0: "background", 1: "wall", 2: "window", 3: "door"}
PLURALS = {1: "walls", 2: "windows", 3: "doors"}
