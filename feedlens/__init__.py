"""feedlens: listings and feed analytics as PySpark DataFrame operators."""
