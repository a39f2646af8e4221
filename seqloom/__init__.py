"""Quality control and counting of sequencing libraries on Spark DataFrames."""
