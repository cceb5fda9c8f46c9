"""Route-pricing analytics as lazy DataFrame-to-DataFrame functions on Spark."""
