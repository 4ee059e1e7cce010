"""Whole jobs: bulk load, model refresh and the registered queries."""
