"""Stages as functions from DataFrames to DataFrames."""
