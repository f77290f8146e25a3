"""Register arithmetic in plain Python, to check the Spark expressions against."""

from __future__ import annotations

import hashlib

MASK = (1 << 63) - 1


def h63(token: str, seed: int = 0) -> int:
    first = int(hashlib.md5(token.encode()).hexdigest()[:16], 16) & MASK
    return first if seed == 0 else h63(f"{first}:{seed}")


def coordinates(h: int, p: int) -> tuple[int, int]:
    low = h & ((1 << (64 - p)) - 1)
    return h >> (63 - p), (low & -low) if low else 1 << (64 - p)


def registers(tokens, p: int = 10) -> dict[int, int]:
    out: dict[int, int] = {}
    for token in tokens:
        b, w = coordinates(h63(token), p)
        out[b] = out.get(b, 0) | w
    return out


def estimate(regs: dict[int, int], p: int, points) -> int:
    m = 1 << p
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(p, 0.7213 / (1 + 1.079 / m))
    raw = alpha * m * m / (sum(2.0 ** -w.bit_length() for w in regs.values()) + m - len(regs))
    if raw <= points[0][0]:
        bias = points[0][1]
    elif raw > points[-1][0]:
        bias = 0.0
    else:
        i = next(i for i, (x, _) in enumerate(points) if x >= raw)
        (x1, y1), (x2, y2) = points[i - 1], points[i]
        bias = y1 + (raw - x1) / (x2 - x1) * (y2 - y1)
    return round(raw - bias)
