"""Readers for chat exports, import bookkeeping and table sinks."""
