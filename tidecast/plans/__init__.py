"""Cleaning and feature plans of the four table shapes, and whole experiments."""
