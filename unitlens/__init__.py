"""unitlens: rental-unit sightings as Spark DataFrames, from landed payload to ranked change."""
