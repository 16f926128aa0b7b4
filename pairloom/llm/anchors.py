"""Content-chosen anchors: every string of a given length holds one, wherever it stands."""

from __future__ import annotations

import numpy as np

from pairloom.llm.common import _BASE, _BASE_INVERSE, _BYTE_VALUES, mix64, powers

_LOW = 20
_MASK = np.uint64((1 << _LOW) - 1)


def gram_hashes(data: np.ndarray, width: int, block: int = 1 << 21) -> np.ndarray:
    """A hash of the `width` bytes from each position on, for the positions that have them."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, block):
            stop = min(n, at + block)
            part = data[at : stop + width - 1]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[part] * powers(_BASE, len(part)), out=sums[1:])
            m = stop - at
            out[at:stop] = mix64((sums[width : width + m] - sums[:m]) * powers(_BASE_INVERSE, m))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(
    data: np.ndarray, bounds: np.ndarray, length: int, width: int, block: int = 1 << 19
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the anchors of the texts `data[bounds[i]:bounds[i+1]]`.

    An anchor is a string of `width` bytes whose hash is the least of those in some string
    of `length` bytes, the first one if several are. Equal strings of `length` bytes hold
    anchors of equal fingerprint. Memory is that of a block, however long a text is.
    """
    window = length - width + 1
    inside = np.zeros(max(0, len(data) - length + 1), dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        inside[a : max(a, b - length + 1)] = True
    found: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
    marks: list[np.ndarray] = [np.empty(0, dtype=np.uint64)]
    for start in range(0, len(inside), block):
        stop = min(len(inside), start + block)
        hashes = gram_hashes(data[start : stop + length - 1], width)
        # a block has fewer places than the low bits can tell apart
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least((hashes & ~_MASK) | place, window)[inside[start:stop]]
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        least = least[new]
        found.append((least & _MASK).astype(np.int64) + start)
        marks.append(least >> np.uint64(_LOW))
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(marks)[first]
