"""Column functions: text of scoreboards and clocks, geometry of boxes and polygons, safe scalars."""
