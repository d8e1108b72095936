"""Marlspike: an evidence-first retrieval and analytics engine on Spark DataFrames."""
