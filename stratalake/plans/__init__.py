"""The five models and the layered build."""
