"""Schemas of the stage tables."""

IMAGES = "image_id string, width int, height int, channels int, data binary, status string"
PIXELS = "image_id string, w int, h int, y int, x int, v int"
COMPONENTS = "image_id string, pixel_id bigint, rep bigint"
BOUNDARY = "image_id string, lo bigint, hi bigint, x int, y int, gx int, gy int"
QUADS = "image_id string, quad_id int, p array<struct<x:float,y:float>>, reversed_border boolean"
DETECTIONS = "image_id string, family string, id int, hamming int, decision_margin float, h array<double>, cx double, cy double, corners array<struct<x:double,y:double>>"
POSES = "image_id string, family string, id int, r array<double>, t array<double>, err double"
