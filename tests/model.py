"""A plain model of the versioned log, to compare with."""

from __future__ import annotations

import random


def random_ops(n: int, keys: int, seed: int, delete_share: float = 0.3) -> list[tuple[int, bytes, int, bytes | None]]:
    """(seq, key, kind, value) in order; some values are empty."""
    r = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        key = b"key-%04d" % r.randrange(keys)
        out.append((seq, key, 0, None) if r.random() < delete_share else (seq, key, 1, b"" if r.random() < 0.1 else b"v-%d" % seq))
    return out


def live(ops, seq: int | None = None) -> dict[bytes, bytes]:
    view: dict[bytes, bytes] = {}
    for s, key, kind, value in sorted(ops):
        if seq is None or s <= seq:
            if kind:
                view[key] = value
            else:
                view.pop(key, None)
    return view
