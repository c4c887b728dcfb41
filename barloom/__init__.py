"""Batch analytics for daily price bars and labelled samples, written for Spark."""
