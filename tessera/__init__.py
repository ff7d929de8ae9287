"""tessera: Spark-native analytics for raster codestreams and the packet streams that carry them."""
