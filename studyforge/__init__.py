"""Learning-analytics and text-evidence operators as PySpark DataFrame functions."""
