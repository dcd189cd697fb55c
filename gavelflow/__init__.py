"""Resale-deal analytics as Spark DataFrame operators."""

from gavelflow.params import Params

__all__ = ["Params"]
