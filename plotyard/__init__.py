"""Listing analytics on Spark: DataFrame-to-DataFrame operators for geolocated property listings."""
