"""lumenmill: a Spark-native engine for raster images and large text corpora."""
