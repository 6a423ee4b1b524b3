"""Maps that keep arriving: files are read once each as a stream and land in the typed tables."""
