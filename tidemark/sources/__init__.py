"""Readers and writers. Compressed archives are unpacked to a landing folder first; Spark cannot split them."""
