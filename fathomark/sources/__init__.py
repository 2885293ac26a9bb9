"""Readers and writers: corpora, manifests, ledgers, predictions, vectors."""
