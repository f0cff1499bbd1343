"""cellscape: geospatial tables (cells, spectra, points, polygons, scenes, series) as Spark DataFrames."""
