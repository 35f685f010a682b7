"""Forecasters over many series, and distributed regressors."""
