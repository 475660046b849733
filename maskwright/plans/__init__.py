"""Driver-side planning over small integers, and the pipeline."""
