"""Image files, models and result files."""
