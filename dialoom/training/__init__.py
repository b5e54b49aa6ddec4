"""Intent classification: data, features, models, search."""
