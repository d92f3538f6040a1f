"""From a specification to DataFrame plans, and from those to the model's sparse tables."""
