"""Evaluations made of several operators: walk-forward regressions, resampling, ensembles and error bands."""
