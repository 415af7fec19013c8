"""Terramill: ranked point-of-interest question analytics as Spark plans."""
