"""tickloom: analytics over time-ordered events, states and segments as Spark DataFrames."""
