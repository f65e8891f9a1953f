"""Attributes proposed from ad text: queueing, verification against the text, merge, evaluation."""
