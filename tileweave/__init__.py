"""Image-collection ETL and raster analytics as Spark DataFrame operators."""
