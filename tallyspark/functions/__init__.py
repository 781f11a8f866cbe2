"""Part of tallyspark."""
