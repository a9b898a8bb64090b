"""Column codecs, block framing, states, single values, compression and accessors."""
