"""Kernels on one image each, NumPy only: masks are 2-D arrays where non-zero is set, lanes
are (n, 2) arrays of x and y. No Spark here; ``operators.frames`` applies them to rows.

Defined results: an empty or all-zero mask has no components and no ring; a lane with under
two usable points draws nothing; measures without a value are None.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Fixed values of the measures.
MISSING = -2
NEAR_TOP, NEAR_BOTTOM = 0.80, 0.95
COUNT_AREA, LANE_AREA = 30, 20
LINE_PIXELS, LINE_MATCH = 20.0, 0.85
LANE_WIDTH, LANE_IOU = 30, 0.5
OUTER, INNER_CONTRAST, INNER_EDGE, BAND = 21, 5, 7, 5
GRAY = (0.299, 0.587, 0.114)
ROW_STEP, OVERLAP, NARROW, WIDE, TOLERANCE = 10, 60, 25.0, 0.7, 0.22
TINY = 1e-8


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit gray or RGB image as PNG, rows without a filter."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of 8-bit gray, palette, RGB or either with alpha, not interlaced.
    Palettes give RGB, alpha is dropped. Anything else raises ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
    if head is None or head[2] != 8 or head[3] not in channels or head[6]:
        raise ValueError("only 8-bit PNG without interlacing")
    width, height, c = head[0], head[1], channels[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * c)
    out = np.zeros((height + 1, width, c), np.int64)
    for y in range(height):
        kind, line, above = raw[y, 0], raw[y, 1:].reshape(width, c).astype(np.int64), out[y]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line, axis=0)
        elif kind == 2:
            now = line + above
        else:
            now = np.zeros_like(line)
            left = corner = np.zeros(c, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    far = np.stack([np.abs(above[x] - corner), np.abs(left - corner), np.abs(left + above[x] - 2 * corner)])
                    guess = np.choose(far.argmin(axis=0), [left, above[x], corner])
                left = now[x] = (line[x] + guess) & 255
                corner = above[x]
        out[y + 1] = now & 255
    pixels = out[1:].astype(np.uint8)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, 0] if c < 3 else pixels[:, :, :3]


def rasterise(lanes: Sequence[np.ndarray], height: int, width: int, thickness: int = 16, moved: bool = True) -> np.ndarray:
    """Lanes as a 0/1 mask: pixels no farther than half the thickness from a segment.
    Points are cut to whole pixels. With ``moved`` those over one image size outside go and
    others are moved to the border first; without, lines run out of the image as they are."""
    mask = np.zeros((height, width), np.uint8)
    half = max(thickness, 1) / 2
    for lane in lanes:
        p = np.asarray(lane, np.float64).reshape(-1, 2)
        if moved:
            p = p[(np.abs(p[:, 0] - width / 2) < 1.5 * width) & (np.abs(p[:, 1] - height / 2) < 1.5 * height)]
            p = np.clip(p, 0, [width - 1, height - 1])
        p = np.trunc(p)
        for a, b in zip(p[:-1], p[1:], strict=True):
            x0, y0 = np.maximum(np.floor(np.minimum(a, b) - half), 0).astype(int)
            x1, y1 = np.ceil(np.maximum(a, b) + half).astype(int) + 1
            if x1 <= 0 or y1 <= 0 or x0 >= width or y0 >= height:
                continue
            y, x = np.mgrid[y0 : min(y1, height), x0 : min(x1, width)]
            d = b - a
            t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, TINY), 0, 1)
            near = np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= half
            mask[y0 : min(y1, height), x0 : min(x1, width)] |= near
    return mask


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of 8-connected parts, in order of their first run; by runs of
    rows, which are joined where they touch."""
    m = np.asarray(mask) != 0
    edge = np.diff(np.pad(m, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    begin = np.searchsorted(row, np.arange(m.shape[0] + 1))
    for y in range(1, m.shape[0]):
        above = slice(begin[y - 1], begin[y])
        for i in range(begin[y], begin[y + 1]):
            touch = np.flatnonzero((first[above] <= last[i]) & (last[above] >= first[i])) + begin[y - 1]
            for j in touch.tolist():
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    number = np.unique(np.array([root(i) for i in range(len(row))], np.int64), return_inverse=True)[1] + 1
    out = np.zeros(m.shape, np.int32)
    for y, a, b, n in zip(row.tolist(), first.tolist(), last.tolist(), number.tolist(), strict=True):
        out[y, a:b] = n
    return out


def component_count(mask: np.ndarray, least: int = COUNT_AREA) -> int:
    return int((np.bincount(components(mask).ravel())[1:] >= least).sum())


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """By an ellipse of odd ``size``: for each of its rows one sliding sum."""
    m = np.asarray(mask) != 0
    h, w = m.shape
    r = size // 2
    sums = np.pad(np.cumsum(m, axis=1), ((0, 0), (1, 0)))
    out = np.zeros_like(m)
    for dy in range(max(-r, 1 - h), min(r, h - 1) + 1):
        dx = int(np.rint(r * np.sqrt(max(r * r - dy * dy, 0)) / max(r, 1)))
        right, left = np.minimum(np.arange(w) + dx + 1, w), np.maximum(np.arange(w) - dx, 0)
        reached = sums[:, right] > sums[:, left]
        out[max(dy, 0) : h + min(dy, 0)] |= reached[max(-dy, 0) : h - max(dy, 0)]
    return out


def overlap(pred: np.ndarray, gt: np.ndarray) -> tuple[int, int, int]:
    """Pixels in both, in ``pred`` only, in ``gt`` only."""
    n = np.bincount(((np.asarray(gt) != 0) * 2 + (np.asarray(pred) != 0)).ravel(), minlength=4)
    return int(n[3]), int(n[1]), int(n[2])


def near_rows(height: int) -> slice:
    return slice(round(height * NEAR_TOP), round(height * NEAR_BOTTOM))


def lane_grid(height: int, step: int = 10) -> list[int]:
    return list(range(step, height, step))


def mask_lanes(mask: np.ndarray, step: int = 10, points: int = 2, area: int = LANE_AREA) -> list[list[int]]:
    """Mean x of each part at the rows of the grid, ``MISSING`` where it has none, from
    left to right by mean; parts of few pixels or rows go."""
    label = components(mask)
    size = np.bincount(label.ravel())
    rows = lane_grid(label.shape[0], step)
    n, x = np.zeros((len(rows), len(size))), np.zeros((len(rows), len(size)))
    for k, y in enumerate(rows):
        n[k] = np.bincount(label[y], minlength=len(size))
        x[k] = np.bincount(label[y], np.arange(label.shape[1]), minlength=len(size))
    at = np.where(n > 0, np.rint(x / np.maximum(n, 1)), MISSING).astype(int)
    kept = [c for c in range(1, len(size)) if size[c] >= area and (n[:, c] > 0).sum() >= points]
    kept.sort(key=lambda c: at[n[:, c] > 0, c].mean() if (n[:, c] > 0).any() else np.inf)
    return [at[:, c].tolist() for c in kept]


def polyline_lanes(lanes: Sequence[np.ndarray], height: int, step: int = 10) -> list[list[int]]:
    """x at the rows of the grid between a lane's ends; lanes that meet no row go."""
    rows = np.array(lane_grid(height, step), np.float64)
    out = []
    for lane in lanes:
        p = np.asarray(lane, np.float64).reshape(-1, 2)
        if len(p) < 2:
            continue
        p = p[np.argsort(p[:, 1])]
        inside = (rows >= p[0, 1]) & (rows <= p[-1, 1])
        if inside.any():
            out.append(np.where(inside, np.rint(np.interp(rows, p[:, 1], p[:, 0])), MISSING).astype(int).tolist())
    return out


def _onto(xs: Sequence[float], source: Sequence[float], rows: Sequence[float]) -> np.ndarray:
    xs, source, rows = (np.asarray(v, np.float64) for v in (xs, source, rows))
    ok = xs >= 0
    if ok.sum() < 2:
        return np.full(len(rows), float(MISSING))
    order = np.argsort(source[ok])
    y, x = source[ok][order], xs[ok][order]
    return np.where((rows >= y[0]) & (rows <= y[-1]), np.interp(rows, y, x), MISSING)


def line_scores(pred: Sequence[Sequence[float]], gt: Sequence[Sequence[float]], rows: Sequence[int], pred_rows: Sequence[int] | None = None) -> tuple[float, float, float]:
    """Accuracy, false positive and false negative share of lanes given by x at rows. A
    lane's points match within 20 pixels across its direction; it is found at 0.85."""
    if len(pred) > len(gt) + 2:
        return 0.0, 0.0, 1.0
    if pred_rows is not None and list(pred_rows) != list(rows):
        pred = [_onto(p, pred_rows, rows) for p in pred]
    y = np.asarray(rows, np.float64)
    p = np.asarray([list(v) for v in pred], np.float64).reshape(len(pred), len(y))
    best = []
    for lane in gt:
        g = np.asarray(lane, np.float64)
        ok = g >= 0
        slope = np.polyfit(y[ok], g[ok], 1)[0] if ok.sum() > 1 else 0.0
        close = np.abs(np.where(p >= 0, p, -100) - np.where(ok, g, -100)) < LINE_PIXELS * np.hypot(1, slope)
        best.append(close.mean(axis=1).max() if len(p) else 0.0)
    found = sum(b >= LINE_MATCH for b in best)
    many = len(gt) > 4  # the worst lane of more than four is forgiven
    of = max(min(4, len(gt)), 1)
    missed = len(gt) - found
    return (sum(best) - (min(best) if many else 0)) / of, (len(pred) - found) / len(pred) if len(pred) else 0.0, (missed - (many and missed > 0)) / of


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest sum, each used once: rows enter one by
    one along shortest augmenting paths."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assign(gain.T))
    n, m = gain.shape
    cost = gain.max(initial=0.0) - gain
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, reach, via = r, 0.0, -1
        while True:
            new = reach + cost[i] - row_price[i] - col_price
            better = ~done & (new < dist)
            dist[better], back[better] = new[better], via
            via = int(np.where(done, np.inf, dist).argmin())
            reach, done[via] = dist[via], True
            if owner[via] < 0:
                break
            i = owner[via]
        row_price[r] += reach
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                row_price[owner[c]] += reach - dist[c]
            col_price[c] -= reach - dist[c]
        while via >= 0:
            owner[via] = owner[back[via]] if back[via] >= 0 else r
            via = back[via]
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def lane_matches(pred: Sequence[np.ndarray], gt: Sequence[np.ndarray], height: int, width: int, thickness: int = LANE_WIDTH, least: float = LANE_IOU) -> tuple[int, int, int]:
    """True positives, false positives, false negatives of drawn lanes, paired for the
    greatest sum of IoU."""
    p, g = ([rasterise([x], height, width, thickness, moved=False) for x in lanes] for lanes in (pred, gt))
    iou = np.array([[(t := overlap(a, b))[0] / max(sum(t), 1) for b in g] for a in p]).reshape(len(p), len(g))
    hit = sum(iou[i, j] >= least for i, j in assign(iou)) if iou.size else 0
    return int(hit), len(p) - int(hit), len(g) - int(hit)


def gray(image: np.ndarray) -> np.ndarray:
    return np.asarray(image, np.float64) if np.ndim(image) == 2 else np.asarray(image, np.float64) @ np.array(GRAY)


def ring(mask: np.ndarray, inner: int, outer: int = OUTER) -> np.ndarray:
    return dilate(mask, outer) & ~dilate(mask, inner)


def contrast(image: np.ndarray, mask: np.ndarray) -> float | None:
    """Difference of mean gray on the marking and around it, of 255; without a ring the
    lower 60 % of the image stand for what is around."""
    on, g = np.asarray(mask) != 0, gray(image)
    around = ring(on, INNER_CONTRAST)
    if not around.any():
        around = ~on & (np.arange(on.shape[0]) >= int(on.shape[0] * 0.40))[:, None]
    return float(min(abs(g[on].mean() - g[around].mean()) / 255, 1.0)) if on.any() and around.any() else None


def sharpness(image: np.ndarray, mask: np.ndarray) -> float | None:
    """Upper quartile of the gradient at the marking's border against that of the ring."""
    on, g = np.asarray(mask) != 0, np.pad(gray(image), 1, mode="reflect")
    square = np.lib.stride_tricks.sliding_window_view
    border = square(np.pad(on, 1), (3, 3)).any(axis=(2, 3)) & ~square(np.pad(on, 1, constant_values=True), (3, 3)).all(axis=(2, 3))
    if not border.any():
        return None
    across, along = g[:, 2:] - g[:, :-2], g[2:] - g[:-2]
    slope = np.hypot(across[:-2] + 2 * across[1:-1] + across[2:], along[:, :-2] + 2 * along[:, 1:-1] + along[:, 2:])
    around = ring(on, INNER_EDGE)
    a = np.percentile(slope[dilate(border, BAND)], 75)
    b = np.percentile(slope[around], 75) if around.any() else np.percentile(slope, 50)
    return float(np.clip((a - b) / (a + b + TINY), 0, 1))


def width_stability(lanes: Sequence[np.ndarray], width: int) -> float | None:
    """How well the gap of neighbouring lanes follows a line in y: 1 less the median
    relative residual of a robust fit over the tolerance, weighted by shared rows."""
    sides = []
    for lane in lanes:
        p = np.asarray(lane, np.float64).reshape(-1, 2)
        p = p[np.argsort(p[:, 1])]
        p = p[np.append(True, np.diff(p[:, 1]) > 1e-6)] if len(p) else p
        if len(p) >= 2 and p[-1, 1] - p[0, 1] >= OVERLAP:
            sides.append(p)
    sides.sort(key=lambda p: p[-1, 0])
    scores, support = [], []
    for a, b in zip(sides, sides[1:], strict=False):
        low, high = max(a[0, 1], b[0, 1]), min(a[-1, 1], b[-1, 1])
        if high - low < OVERLAP:
            continue
        y = np.arange(low, high, ROW_STEP)
        gap = np.interp(y, b[:, 1], b[:, 0]) - np.interp(y, a[:, 1], a[:, 0])
        ok = (gap > NARROW) & (gap < WIDE * width)
        if ok.sum() < 6:
            continue
        y, gap = y[ok], gap[ok]
        weight = np.ones(len(y))
        for _ in range(3):
            line = np.polyval(np.polyfit(y, gap, 1, w=weight), y)
            off = np.abs(gap - line)
            weight = 1 / np.maximum(off / max(np.median(off), TINY), 0.5)
        scores.append(np.clip(1 - np.median(off / np.maximum(line, TINY)) / TOLERANCE, 0, 1))
        support.append(y[-1] - y[0])
    return float(np.average(scores, weights=support)) if scores else None
