"""Reading and writing reports, manifests, directories and archives."""
