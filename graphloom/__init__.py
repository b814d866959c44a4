"""graphloom: code-graph analytics and table operators on Spark DataFrames."""
