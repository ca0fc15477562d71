"""Built-up-area delineation and training-data preparation as PySpark DataFrame programs."""
