"""Training-data operators: token counts, toxicity, near duplicates, packing, decontamination, chat formatting, personal data, secrets, embeddings and packed token matrices.

Nothing else in the library imports this subpackage; `queries.py` holds its registered queries.
"""
