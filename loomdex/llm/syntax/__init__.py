"""Generalised LL recognition of source text: gll has the engine, the other modules a language each."""
