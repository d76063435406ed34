"""Training-data operators: ten corpus jobs and the pipeline built from them."""
