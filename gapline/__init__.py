"""Critic/audience score-gap analytics on Spark DataFrames."""
