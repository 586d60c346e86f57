"""Local event listings and venue-density analytics as PySpark DataFrame operators."""
