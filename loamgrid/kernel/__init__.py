"""Planar geometry in numpy: noding, faces, overlay, buffers, triangulation, trees."""
