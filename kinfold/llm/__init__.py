"""Training-data operators: each module is one operator, DataFrame in and DataFrame out."""
