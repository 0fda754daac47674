"""Reading files into rows and writing rows out."""
