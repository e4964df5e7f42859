"""Knowledge-graph analytics as ordinary Spark plans."""
