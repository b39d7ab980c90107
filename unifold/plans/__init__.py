"""Whole plans: the pipeline, its command line and the registered queries."""
