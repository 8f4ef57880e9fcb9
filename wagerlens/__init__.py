"""Wagering-flow analytics on Spark."""
