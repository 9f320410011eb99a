"""Schemas of the tables that operators exchange."""

from __future__ import annotations

PAIR = "pair_id string, primary date, secondary date, days int"
PIXEL = "scene_id string, band int, row int, col int, value double"
IFG = "pair_id string, row int, col int, phase double, coh double"
SERIES = "row int, col int, d array<double>"
BASELINE = "date date, value double"
POINT = "point_id long, x double, y double"
BOX = "box_id long, left double, bottom double, right double, top double"
POLYGON = "poly_id long, type string, rings array<array<struct<x:double,y:double>>>"
GRID = "width int, height int, left double, top double, xres double, yres double, crs string, nodata double"
SCENE = "path string, name string, size long, valid boolean"
