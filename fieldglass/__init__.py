"""fieldglass: data-quality, measurement, registry and scoring analytics on PySpark DataFrames."""
