"""Network, terrain and zonal analytics expressed as PySpark DataFrame plans."""
