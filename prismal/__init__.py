"""Raster, symbol-stream and media analytics as Spark DataFrame operators."""
