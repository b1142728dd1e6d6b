"""Readers, decoders and stores."""
