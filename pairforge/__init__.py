"""Building and evaluating labelled pair datasets on Spark."""
