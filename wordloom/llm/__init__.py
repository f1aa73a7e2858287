"""Training-data operators: decontamination, language ID, near-dedup, tokenizers, PII, licences, quality, toxicity."""
