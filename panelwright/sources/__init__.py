"""Readers for the raw text, CSV and GeoJSON inputs and writers for the outputs."""
