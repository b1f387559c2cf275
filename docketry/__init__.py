"""Docketry: filing analytics and training-data operators as Spark plans."""
