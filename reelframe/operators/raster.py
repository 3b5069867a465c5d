"""Numpy kernels on whole frames: resampling, palettes, dithering."""

from __future__ import annotations

import numpy as np


def _lanczos(n_in: int, n_out: int, a: int = 3) -> np.ndarray:
    scale = max(1.0, n_in / n_out)
    centre = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    x = (np.arange(n_in)[None, :] - centre[:, None]) / scale
    k = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return k / k.sum(1, keepdims=True)


def resize(px: np.ndarray, w: int, h: int) -> np.ndarray:
    """Lanczos in both directions; colour is weighted by opacity, so hidden colour doesn't bleed."""
    f = px.astype(np.float64)
    alpha = f[..., 3:] / 255
    f = np.concatenate((f[..., :3] * alpha, f[..., 3:]), -1)
    f = np.einsum("yi,ijc->yjc", _lanczos(px.shape[0], h), f)
    f = np.einsum("xj,yjc->yxc", _lanczos(px.shape[1], w), f)
    a = np.clip(f[..., 3:], 0, 255)
    rgb = np.where(a > 0, f[..., :3] * 255 / np.maximum(a, 1e-9), 0)
    return np.clip(np.floor(np.concatenate((rgb, a), -1) + 0.5), 0, 255).astype(np.uint8)


def median_cut(colours: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """At most n palette colours: boxes are cut at the weighted median of their longest side."""
    boxes = [np.arange(len(colours))]
    while len(boxes) < n:
        spread = [(np.ptp(colours[b], axis=0).max() * counts[b].sum() if len(b) > 1 else -1) for b in boxes]
        k = int(np.argmax(spread))
        if spread[k] <= 0:
            break
        b = boxes.pop(k)
        side = int(np.ptp(colours[b], axis=0).argmax())
        b = b[np.argsort(colours[b, side], kind="stable")]
        half = int(np.searchsorted(np.cumsum(counts[b]), counts[b].sum() / 2)) + 1
        half = min(max(1, half), len(b) - 1)
        boxes += [b[:half], b[half:]]
    means = [np.average(colours[b], axis=0, weights=counts[b]) for b in boxes]
    return np.floor(np.array(means) + 0.5).astype(np.uint8)


def nearest(px: np.ndarray, palette: np.ndarray) -> np.ndarray:
    d = ((px[..., None, :].astype(np.int32) - palette[None, None].astype(np.int32)) ** 2).sum(-1)
    return d.argmin(-1).astype(np.uint8)


#: Shares of the error in sixteenths that go to (dx, dy).
FLOYD_STEINBERG = [(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)]


def diffuse(channel: np.ndarray, levels: int) -> np.ndarray:
    """Error diffusion of one channel to ``levels`` steps."""
    f = channel.astype(np.float64).copy()
    h, w = f.shape
    step = 255 / (levels - 1)
    for y in range(h):
        for x in range(w):
            old = f[y, x]
            new = min(levels - 1, max(0, int(old / step + 0.5))) * step
            f[y, x] = new
            for dx, dy, share in FLOYD_STEINBERG:
                if 0 <= x + dx < w and y + dy < h:
                    f[y + dy, x + dx] += (old - new) * share / 16
    return np.clip(np.floor(f + 0.5), 0, 255).astype(np.uint8)
