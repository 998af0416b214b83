"""Where documents, configuration and model output come from."""
