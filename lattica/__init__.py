"""Diagram analytics on Spark: typed records of images and model answers, and the operators over them."""
