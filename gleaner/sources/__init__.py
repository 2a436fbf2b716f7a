"""Reading corpora into the data model and writing results."""
