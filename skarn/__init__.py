"""Structural-debt and corpus analytics expressed as Spark DataFrame plans."""
