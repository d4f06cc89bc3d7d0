"""From descriptors and SQL texts to DataFrame plans."""
