"""Reading and writing of the file formats around the tables."""
