"""Column functions: text normalisation, repeatable random numbers, vector algebra and sense priors."""
