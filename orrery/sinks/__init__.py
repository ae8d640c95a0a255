"""Writers of GeoJSON, GeoPackage, PNG and reports."""
