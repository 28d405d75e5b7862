"""Readers and writers of the artefacts: tables, vectors in .npy files, evaluation records, objects by name."""
