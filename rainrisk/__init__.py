"""Natural-hazard analytics for road networks on PySpark."""
