"""Readers and writers: landed feeds, warehouse tables, GeoJSON, CSV."""
