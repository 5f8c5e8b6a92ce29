"""Spatial reconstruction evidence as Spark DataFrames.

Frames, depth pixels, calibrated views, point clouds, sparse tracks and pose
graphs are ordinary tables here; operators are plain functions from DataFrame
to DataFrame.
"""

__version__ = "0.1.0"
