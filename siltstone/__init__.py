"""Hybrid document retrieval, governed analytics and corpus preparation on Spark."""
