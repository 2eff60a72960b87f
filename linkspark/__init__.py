"""linkspark: fuzzy record matching and numeric operators as Spark DataFrame plans."""
