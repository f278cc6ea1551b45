"""Reading, writing and generating graphs."""
