"""quadrille: Spark-native spatio-temporal demand analytics on dense region-by-interval panels."""
