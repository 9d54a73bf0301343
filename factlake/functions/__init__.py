from . import replies, text, times, vectors

__all__ = ["replies", "text", "times", "vectors"]
