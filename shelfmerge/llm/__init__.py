"""Training-data operators over documents, pages, conversations and embeddings."""
