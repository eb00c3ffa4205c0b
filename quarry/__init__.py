"""Knowledge-base data jobs expressed as Spark DataFrame programs."""
