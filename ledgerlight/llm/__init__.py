"""Operators for building training corpora: mixing, fingerprints, scoring,
de-duplication, filters, packing and sharding.  Nothing else in the library
imports this subpackage."""
