"""Training-data operators over the tables of documents and pages. Nothing else in the library imports this package."""
