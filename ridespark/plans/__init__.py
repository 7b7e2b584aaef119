"""Shapes of Spark plans that several operators share."""
