"""spanledger: agent-activity analytics on Spark DataFrames."""
