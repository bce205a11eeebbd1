"""Reading and writing of lines."""
