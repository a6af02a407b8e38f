"""terrafold: raster, vector and corpus analytics expressed as Spark jobs."""
