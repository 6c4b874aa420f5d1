"""Streams: the engine works on bounded tables only; nothing here yet."""
