"""bitloom: bit-register set sketches, token indexes and entity graphs on Spark."""

__version__ = "0.1.0"
