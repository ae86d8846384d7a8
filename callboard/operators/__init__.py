"""DataFrame to DataFrame building blocks, with column names as arguments."""
