"""Logical plans: the graph model, lookups, reports, the SPARQL front-end and rendering."""
