"""DataFrame operators: ranking metrics, correlation, resampling, splits, containment, tiles, summaries, models."""
