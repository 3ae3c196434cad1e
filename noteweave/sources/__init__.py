"""Readers that bring stored tables into the shapes the operators take."""
