"""darkroom: cataloguing and planning for media collections, as Spark DataFrames."""
