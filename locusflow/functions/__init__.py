"""See the package README for the layer this belongs to."""
