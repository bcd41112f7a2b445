"""Training-data operators: encoding, de-duplication, mixing, scoring, formatting, extraction, filtering.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
