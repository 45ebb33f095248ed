"""Multi-operator plans: whole jobs put together from the operators."""
