"""Analytics of interval features with sparse per-sample counts, as DataFrame functions on Spark."""
