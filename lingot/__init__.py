"""Text localization and artifact analytics on Spark."""
