"""Ink of page pictures: profiles, bit maps and edges, in numpy over a column of pictures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

BANDS, LIGHT, DARK = 400, 235, 170


def profile(picture: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The share of each of a page's horizontal bands that is darker than paper."""
    rows = (picture < LIGHT).mean(axis=1)
    edges = np.linspace(0, len(rows), bands + 1)
    run = np.concatenate([[0], np.cumsum(rows)])
    at = np.interp(edges, np.arange(len(run)), run)
    return np.diff(at) / np.maximum(np.diff(edges), 1e-12)


def bit_map(picture: np.ndarray) -> bytes:
    """Dark pixels as bits, each row padded to whole bytes, the highest bit leftmost."""
    return np.packbits(picture < DARK, axis=1).tobytes()


def unpacked(bits: bytes, width: int, height: int) -> np.ndarray:
    stride = (width + 7) // 8
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(height, stride), axis=1)[:, :width].astype(bool)


def edge(dark: np.ndarray, rect: tuple[float, float, float, float], side: str) -> dict[str, float]:
    """Dark share of the pixels just inside an edge, and how many cross it: dark inside and outside."""
    h, w = dark.shape
    left, top, right, bottom = rect
    x0, x1, y0, y1 = int(left * w), min(w, int(np.ceil(right * w))), int(top * h), min(h, int(np.ceil(bottom * h)))
    if side in ("top", "bottom"):
        i = y0 if side == "top" else y1 - 1
        o = i - 1 if side == "top" else i + 1
        inside = dark[min(max(i, 0), h - 1), x0:x1]
        outside = dark[o, x0:x1] if 0 <= o < h else np.zeros_like(inside)
    else:
        i = x0 if side == "left" else x1 - 1
        o = i - 1 if side == "left" else i + 1
        inside = dark[y0:y1, min(max(i, 0), w - 1)]
        outside = dark[y0:y1, o] if 0 <= o < w else np.zeros_like(inside)
    across = inside & outside
    runs = np.diff(np.flatnonzero(np.diff(np.concatenate([[0], across.astype(int), [0]]))))[::2]
    return {"share": float(inside.mean()) if len(inside) else 0.0, "crossing": int(across.sum()), "longest": int(runs.max()) if len(runs) else 0}


def is_cut(found: dict[str, float]) -> bool:
    return found["crossing"] >= 2 or found["share"] > 0.02


def clean_edge(dark: np.ndarray, rect: tuple[float, float, float, float], side: str, inward: float = 0.024, outward: float = 0.012) -> float | None:
    """Where an edge that cuts ink can go so that it cuts none: the nearest place, inward before outward; None where there is none."""
    names = ("left", "top", "right", "bottom")
    k = names.index(side)
    size = dark.shape[1] if side in ("left", "right") else dark.shape[0]
    sign = 1 if side in ("left", "top") else -1
    if not is_cut(edge(dark, rect, side)):
        return rect[k]
    for d in range(1, int(inward * size) + 1):
        for way, reach in ((sign, inward), (-sign, outward)):
            if d > reach * size:
                continue
            moved = list(rect)
            moved[k] = min(1.0, max(0.0, rect[k] + way * d / size))
            if moved[0] < moved[2] and moved[1] < moved[3] and not is_cut(edge(dark, tuple(moved), side)):
                return moved[k]
    return None


def poke_depth(dark: np.ndarray, row: int, across: int = 40, most: int = 4) -> int:
    """How far the marks that cross a row reach to either side of it, the lesser side, at most `most`; marks are 8-connected."""
    best = 0
    h, w = dark.shape
    seen = np.zeros_like(dark)
    for x in np.flatnonzero(dark[row] & dark[row - 1]) if row > 0 else []:
        if seen[row, x]:
            continue
        todo, up, down = [(row, x)], 0, 0
        seen[row, x] = True
        while todo:
            y, c = todo.pop()
            up, down = max(up, row - y), max(down, y - row + 1)
            for ny in range(max(0, y - 1, row - across), min(h, y + 2, row + across)):
                for nx in range(max(0, c - 1), min(w, c + 2)):
                    if dark[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        todo.append((ny, nx))
        best = max(best, min(up, down))
    return min(best, most)


@pandas_udf(ArrayType(DoubleType()))
def profiles(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Ink profiles of grey pictures, a byte for each pixel."""
    return pd.Series([None if p is None else profile(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) for p, w, h in zip(pixels, width, height, strict=True)])


@pandas_udf(BinaryType())
def bit_maps(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else bit_map(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) for p, w, h in zip(pixels, width, height, strict=True)])
