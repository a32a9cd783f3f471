"""The image analysis and the registered queries."""
