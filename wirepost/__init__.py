"""Mail-transport security posture, computed with Spark DataFrames."""
