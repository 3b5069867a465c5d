"""Readers and writers of the formats that need no external program; others are plug-ins."""

from __future__ import annotations

from collections.abc import Callable

#: Encoders and decoders for formats without a built-in codec, by format name.
PLUGINS: dict[str, Callable] = {}
BUILT_IN = ("gif", "png", "apng")


class CodecUnavailable(RuntimeError):
    """The format needs a codec that isn't registered."""


def register(fmt: str, codec: Callable) -> None:
    PLUGINS[fmt] = codec


def plugin(fmt: str) -> Callable:
    if fmt not in PLUGINS:
        raise CodecUnavailable(f"no codec for {fmt!r}: built in are {', '.join(BUILT_IN)}; register() adds others")
    return PLUGINS[fmt]
