"""Text operators for training-data pipelines.

Nothing outside this folder imports it; it can be deleted as a whole.
"""
