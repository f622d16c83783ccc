"""Bitemporal facts and Datalog queries on Spark DataFrames."""
