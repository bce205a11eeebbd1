"""Microblog user analytics and training-data operators on Spark."""
