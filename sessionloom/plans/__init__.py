"""DataFrame-to-DataFrame stages of the refinery."""
