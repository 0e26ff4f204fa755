"""Perturbation-robustness analytics on Spark."""
