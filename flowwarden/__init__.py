"""Rule-based monitoring of packet and flow data on Spark DataFrames."""
