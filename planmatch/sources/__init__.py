"""Reading catalogs, documents and recorded replies; shared scratch tables."""
