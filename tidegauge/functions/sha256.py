"""SHA-256 that can be put down after any byte and taken up in another process.

The digest of a file is one chain, and ``hashlib`` keeps its state to itself.  OpenSSL's own functions, which ``hashlib``
is linked with, work on a plain structure (``SHA256_CTX``): its bytes are the state.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    _fields_ = [
        ("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32),
        ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint),
    ]


@cache
def _openssl() -> ctypes.CDLL:
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return lib


class Sha256:
    def __init__(self, state: bytes | None = None):
        self._context = _Context()
        if state is None:
            _openssl().SHA256_Init(ctypes.byref(self._context))
        else:
            ctypes.memmove(ctypes.byref(self._context), state, ctypes.sizeof(_Context))

    def update(self, data: bytes) -> None:
        _openssl().SHA256_Update(ctypes.byref(self._context), data, len(data))

    def state(self) -> bytes:
        return bytes(self._context)

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), Sha256(self.state())
        _openssl().SHA256_Final(out, ctypes.byref(last._context))
        return out.raw.hex()


@cache
def resumable() -> bool:
    """Whether this Python's OpenSSL offers these functions and they give the digest of ``hashlib``."""
    try:
        first = Sha256()
        first.update(b"x" * 1000)
        second = Sha256(first.state())
        second.update(b"y" * 77)
        return second.hexdigest() == hashlib.sha256(b"x" * 1000 + b"y" * 77).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False
