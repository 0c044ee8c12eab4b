"""Sales-export preparation and product segmentation as Spark DataFrame jobs."""
