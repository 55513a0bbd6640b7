"""threadlens: searching and analysing versioned conversation history with PySpark DataFrames."""
