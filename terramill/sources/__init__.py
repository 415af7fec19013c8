"""Reading and writing of corpora and question sets."""
