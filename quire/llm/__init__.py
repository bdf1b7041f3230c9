"""Operators of a training-data pipeline: packing, id files, joins, models, mixing, archives."""
