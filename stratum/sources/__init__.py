"""Sources and sinks: page discovery, OCR results in several shapes, archives, GeoJSON, grid files, connectors."""
