"""Key ranges, value codecs, text analysis: pieces that become Column expressions."""
