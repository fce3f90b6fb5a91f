"""Operators for training-data pipelines. Nothing else in emberscan imports this."""
