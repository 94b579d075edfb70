"""Stateful steps of recording, and auxiliary dataflows, as batch plans."""
