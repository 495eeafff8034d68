"""Pixel kernels in numpy, for one image or tile in a worker. Arrays are H × W (gray) or H × W × 3 (blue, green, red), 8 bits."""

from __future__ import annotations

import numpy as np


def to_gray(img: np.ndarray) -> np.ndarray:
    """As ``operators.pixels.gray``: fixed-point luma."""
    if img.ndim == 2:
        return img
    b, g, r = (img[..., k].astype(np.int64) for k in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) // 16384).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    apart = np.where((w > 0) & (w < w[-1]), (s[-1] * w - w[-1] * s) ** 2 / np.maximum(w * (w[-1] - w), 1), 0)
    return int(np.argmax(apart))


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of three sigmas' reach, edges mirrored."""
    reach = int(3 * sigma + 0.5)
    k = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    x = x.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(x.ndim)]
        p = np.pad(x, pad, mode="symmetric")
        x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    return x


def sharpened(img: np.ndarray, amount: float = 1.5, sigma: float = 3.0) -> np.ndarray:
    return np.clip(np.rint((1 + amount) * img - amount * blurred(img, sigma)), 0, 255).astype(np.uint8)


def clahe(gray: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Histogram equalisation by cells: clipped histograms, and levels interpolated between the cells around a pixel."""
    h, w = gray.shape
    ys, xs = (np.linspace(0, n, grid + 1).astype(int) for n in (h, w))
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            cell = gray[ys[i]:ys[i + 1], xs[j]:xs[j + 1]].ravel()
            if not len(cell):
                maps[i, j] = np.arange(256)
                continue
            n = np.bincount(cell, minlength=256).astype(float)
            top = max(1.0, clip * len(cell) / 256)
            spare = np.maximum(n - top, 0).sum()
            maps[i, j] = (np.cumsum(np.minimum(n, top)) + spare * np.arange(1, 257) / 256) * 255 / len(cell)

    def between(n: int, edges: np.ndarray):
        at = np.clip(np.interp(np.arange(n), (edges[:-1] + edges[1:] - 1) / 2, np.arange(grid)), 0, grid - 1)
        low = np.minimum(at.astype(int), max(0, grid - 2))
        return low, np.minimum(low + 1, grid - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, ys), between(w, xs)
    level = lambda a, b: maps[a[:, None], b[None, :], gray]
    fy, fx = fy[:, None], fx[None, :]
    out = (level(y0, x0) * (1 - fx) + level(y0, x1) * fx) * (1 - fy) + (level(y1, x0) * (1 - fx) + level(y1, x1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resized(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the covered area where an axis shrinks, linear between pixel centres where it grows."""
    out = img.astype(np.float64)
    for axis, new in ((0, height), (1, width)):
        old = out.shape[axis]
        shape = [-1 if a == axis else 1 for a in range(out.ndim)]
        if new < old:
            edge = np.linspace(0, old, new + 1)
            total = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
            low = np.floor(edge).astype(int)
            at = np.take(total, low, axis) + np.take(out, np.minimum(low, old - 1), axis) * (edge - low).reshape(shape)
            out = np.diff(at, axis=axis) / (old / new)
        elif new > old:
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.minimum(at.astype(int), max(0, old - 2))
            part = (at - low).reshape(shape)
            out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, old - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _around(mask: np.ndarray, how, outside: bool) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=outside)
    return how.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])


def eroded(mask: np.ndarray) -> np.ndarray:
    return _around(mask, np.logical_and, True)


def dilated(mask: np.ndarray) -> np.ndarray:
    return _around(mask, np.logical_or, False)


def skeleton(mask: np.ndarray) -> np.ndarray:
    """What each opening takes away while the mask is eroded; at most as many rounds as the image is long, as a full mask never erodes."""
    left, out = mask.astype(bool), np.zeros(mask.shape, bool)
    for _ in range(max(mask.shape)):
        if not left.any():
            break
        thinner = eroded(left)
        out |= left & ~dilated(thinner)
        if (thinner == left).all():
            break
        left = thinner
    return out


def thickness(mask: np.ndarray) -> float:
    """Pixels of ink for each pixel of its skeleton; 1 without a skeleton."""
    line = int(skeleton(mask).sum())
    return float(mask.sum()) / line if line else 1.0


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels from 1 of connected regions, in reading order; 0 outside. Runs of rows are joined where they touch, with ``diagonal`` at a corner too."""
    h, w = mask.shape
    p = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    edge = np.diff(p, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    # runs at row * wide + place: those of the next row that a run touches stand one after another
    wide, reach = w + 2, int(diagonal)
    first, last = row * wide + start, row * wide + end
    low = np.searchsorted(last, first + wide - reach, side="right")
    n = np.maximum(np.searchsorted(first, last + wide + reach) - low, 0)
    upper = np.repeat(np.arange(len(row)), n)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while True:  # the larger root of two that touch goes under the smaller one
        one, two = root[upper], root[lower]
        if (one == two).all():
            break
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
    name = np.unique(root, return_inverse=True)[1].astype(np.int32) + 1
    step = np.zeros((h, w + 1), np.int32)
    step[row, start], step[row, end] = name, -name
    return np.cumsum(step, axis=1, dtype=np.int32)[:, :w]


def regions(labels: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height and pixels of each region."""
    y, x = np.nonzero(labels)
    label = labels[y, x] - 1
    n = np.bincount(label)
    low, high = np.full((2, len(n)), max(labels.shape)), np.zeros((2, len(n)), np.int64)
    for k, at in enumerate((x, y)):
        np.minimum.at(low[k], label, at)
        np.maximum.at(high[k], label, at)
    return list(zip(*low.tolist(), *(high - low + 1).tolist(), n.tolist()))


def outer(mask: np.ndarray) -> np.ndarray:
    """Labels of the regions that the outside of the image reaches: those within a hole of another one go."""
    labels = components(mask)
    free = np.pad(~mask.astype(bool), 1, constant_values=True)
    outside = components(free, diagonal=False)
    reached = _around(np.pad(outside == outside[0, 0], 0), np.logical_or, False)[1:-1, 1:-1]
    seen = np.unique(labels[reached & (labels > 0)])
    keep = np.zeros(int(labels.max(initial=0)) + 1, np.int32)
    keep[seen] = np.arange(1, len(seen) + 1)
    return keep[labels]


def text_density(mask: np.ndarray) -> float:
    """The share of an image in small, evenly sided regions."""
    total = mask.size
    return sum(n for _, _, w, h, n in regions(components(mask)) if n < 0.005 * total and 0.1 < w / h < 10) / total


def characteristics(img: np.ndarray) -> dict[str, float]:
    gray = to_gray(img)
    mask = gray <= otsu(gray) if gray.min() < gray.max() else np.zeros(gray.shape, bool)
    ink = img[mask] if img.ndim == 3 else None
    colours = 1 if img.ndim == 2 else 0 if not len(ink) else distinct_colours(ink)
    return {"mean_line_thickness": thickness(mask), "line_density": float(mask.mean()), "contrast_score": float(gray.std()), "text_density": text_density(mask), "num_distinct_colors": colours}


def kmeans(data: np.ndarray, k: int, runs: int = 10, steps: int = 50, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, labels and inertia of the best of some seeded runs, the first of equals; k is at most the number of points."""
    rng, data, best = np.random.default_rng(seed), np.asarray(data, float), None
    k = min(k, len(data))
    for _ in range(runs):
        centres = data[[rng.integers(len(data))]]
        while len(centres) < k:
            d = ((data[:, None] - centres) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else None
            centres = np.concatenate([centres, data[[rng.choice(len(data), p=p)]]])
        for _ in range(steps):
            label = ((data[:, None] - centres) ** 2).sum(-1).argmin(1)
            new = np.stack([data[label == c].mean(0) if (label == c).any() else data[rng.integers(len(data))] for c in range(k)])
            done = np.allclose(new, centres, atol=1e-4)
            centres = new
            if done:
                break
        inertia = float(((data - centres[label]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = (centres, label, inertia)
    return best


def distinct_colours(points: np.ndarray, most: int = 12, sample: int = 10_000, ratio: float = 0.8) -> int:
    """The k from 2 at which inertia stops falling; a fixed sample of the points bounds the work, as this is an estimate."""
    points = np.asarray(points, float)
    if len(points) > sample:
        points = points[np.random.default_rng(42).choice(len(points), sample, replace=False)]
    if len(points) < 2:
        return len(points)
    last = kmeans(points, 2, runs=3)[2]
    for k in range(3, min(most, len(points)) + 1):
        now = kmeans(points, k, runs=3)[2]
        if last == 0 or now / last > ratio:
            return k - 1
        last = now
    return min(most, len(points))


def edges(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Gradients that are largest across their direction, and are strong or touch strong ones."""
    g = np.pad(blurred(gray, 1.0), 1, mode="edge")
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    size = np.hypot(gx, gy)
    p = np.pad(size, 1)
    sector = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    peak = np.zeros(size.shape, bool)
    h, w = size.shape
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w], p[1 - dy:1 - dy + h, 1 - dx:1 - dx + w]
        peak |= (sector == s) & (size >= ahead) & (size > behind)
    weak = peak & (size > low)
    labels = components(weak)
    strong = np.unique(labels[weak & (size > high)])
    return weak & np.isin(labels, strong[strong > 0])


def line_segments(gray: np.ndarray, min_length: int = 30, votes: int = 50, max_gap: int = 10) -> list[tuple[int, int, int, int]]:
    """Segments x1, y1, x2, y2: the fullest lines of a Hough space by turns, cut at gaps; their points leave the space."""
    left = edges(gray)
    theta = np.deg2rad(np.arange(180))
    cos, sin, out = np.cos(theta), np.sin(theta), []
    reach = int(np.hypot(*gray.shape)) + 1
    y, x = np.nonzero(left)
    alive = np.ones(len(y), bool)
    rho = np.rint(x[:, None] * cos + y[:, None] * sin).astype(int) + reach
    space = np.zeros((2 * reach + 1, 180), int)
    np.add.at(space, (rho, np.arange(180)[None, :]), 1)
    while len(y) and space.max() >= votes:
        r, t = np.unravel_index(space.argmax(), space.shape)
        on = np.flatnonzero(alive & (np.abs(rho[:, t] - r) <= 1))
        along = -x[on] * sin[t] + y[on] * cos[t]
        order = np.argsort(along, kind="stable")
        on, along = on[order], along[order]
        for part in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > max_gap) + 1):
            if len(part) and along[part[-1]] - along[part[0]] >= min_length:
                a, b = on[part[0]], on[part[-1]]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
        np.add.at(space, (rho[on], np.arange(180)[None, :]), -1)
        alive[on] = False
        space[r, t] = 0
    return out


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """The border of the region that the first pixel belongs to, clockwise, by walking around it."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return []
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    p = np.pad(mask, 1)
    start = at = (int(ys[0]) + 1, int(xs[0]) + 1)
    way, path, seen = 0, [], set()
    while (at, way) not in seen:
        seen.add((at, way))
        path.append((at[1] - 1, at[0] - 1))
        for turn in range(8):
            d = (way + 6 + turn) % 8
            new = (at[0] + steps[d][0], at[1] + steps[d][1])
            if p[new]:
                at, way = new, d
                break
        else:
            break
    return path[:-1] if len(path) > 1 and path[-1] == (start[1] - 1, start[0] - 1) else path


def simplified(path: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """The corners of a closed path: points that stand off by more than the tolerance."""
    if len(path) < 3:
        return path
    pts = np.array(path, float)
    far = int(((pts - pts[0]) ** 2).sum(1).argmax())
    keep, work = {0, far}, [(0, far), (far, len(pts))]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q = pts[a], pts[b % len(pts)]
        d = q - p
        inner = pts[a + 1:b] - p
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / max(np.hypot(*d), 1e-9) if np.hypot(*d) > 0 else np.hypot(*inner.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return [path[k] for k in sorted(keep)]


def contours(gray: np.ndarray, sigma: float) -> list[dict]:
    """Outer outlines of the edges of a blurred image: path, box, area, length and centre (by moments; of the box without an area)."""
    found = []
    labels = outer(dilated(edges(blurred(gray, sigma).astype(np.uint8))))
    for k, (x, y, w, h, _) in enumerate(regions(labels), 1):
        path = outline(labels == k)
        if len(path) < 3:
            continue
        pts = np.array(path, float)
        nxt = np.roll(pts, -1, axis=0)
        cross = pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]
        centre = ((pts + nxt) * cross[:, None]).sum(0) / (3 * cross.sum()) if cross.sum() else np.array([x + w // 2, y + h // 2])
        found.append({"path": path, "x": x, "y": y, "width": w, "height": h, "area": abs(float(cross.sum())) / 2,
                      "around": float(np.hypot(*(nxt - pts).T).sum()), "cx": int(centre[0]), "cy": int(centre[1])})
    return found


def _box(c: dict) -> dict:
    return {**{k: c[k] for k in ("x", "y", "width", "height")}, "area": round(c["area"], 2)}


def shapes(gray: np.ndarray, min_area: float = 500, max_area: float = float("inf")) -> list[dict]:
    """Outer outlines with their type, box, area and centre."""
    found = []
    for c in contours(gray, 1.1):
        if min_area <= c["area"] <= max_area:
            corners = len(simplified(c["path"], 0.02 * c["around"]))
            round_ = c["around"] and 4 * np.pi * c["area"] / c["around"] ** 2 > 0.75
            kind = "rectangle" if corners == 4 else "circle" if round_ else "polygon"
            found.append({"type": kind, **_box(c), "cx": c["cx"], "cy": c["cy"]})
    return found


def rectangles(gray: np.ndarray, min_area: float = 500) -> list[dict]:
    """Boxes and areas of outlines of four corners, found with twice the tolerance of ``shapes``."""
    return [_box(c) for c in contours(gray, 1.1) if c["area"] >= min_area and len(simplified(c["path"], 0.04 * c["around"])) == 4]


def icons(gray: np.ndarray, min_area: float = 100, max_area: float = 5000) -> list[dict]:
    """Boxes, areas and centres of small outlines, less blurred."""
    return [{**_box(c), "cx": c["cx"], "cy": c["cy"]} for c in contours(gray, 0.8) if min_area <= c["area"] <= max_area]


def along(img: np.ndarray, x1: int, y1: int, x2: int, y2: int, n: int = 20) -> np.ndarray:
    """The values at n evenly spaced points from one end to the other, cut to pixels and kept inside the image."""
    xs, ys = (np.linspace(a, b, n).astype(int) for a, b in ((x1, x2), (y1, y2)))
    return img[np.clip(ys, 0, img.shape[0] - 1), np.clip(xs, 0, img.shape[1] - 1)]


def described_lines(img: np.ndarray, min_length: int = 30, votes: int = 50, max_gap: int = 10) -> list[dict]:
    """Segments with length, angle (0 to 90), mean red, green and blue along them, and whether they are dashed."""
    colour = img if img.ndim == 3 else np.repeat(img[:, :, None], 3, axis=2)
    gray, found = to_gray(img), []
    for x1, y1, x2, y2 in line_segments(gray, min_length, votes, max_gap):
        mean = along(colour, x1, y1, x2, y2).mean(axis=0).astype(int)
        side = np.sign((s := along(gray, x1, y1, x2, y2, 40).astype(float)) - s.mean())
        found.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "length": round(float(np.hypot(x2 - x1, y2 - y1)), 2),
                      "angle": round(float(np.degrees(np.arctan2(abs(y2 - y1), abs(x2 - x1)))), 2),
                      "r": int(mean[2]), "g": int(mean[1]), "b": int(mean[0]), "is_dashed": int(np.count_nonzero(np.diff(side))) >= 6})
    return found


def clustered_colours(points: np.ndarray, k: int | None = None) -> list[dict]:
    """Centres of a list of colours, cut to integers; without k, the last k from 2 at which inertia falls enough. Each with the number of points that
    equal it, by that number."""
    points = np.asarray(points, float).reshape(-1, 3)
    if not len(points):
        return []
    k = 1 if len(points) < 2 else min(k or distinct_colours(points, sample=len(points)), len(points))
    centres = kmeans(points, k)[0].astype(int) if len(points) > 1 else points.astype(int)
    rows = [{"r": int(c[0]), "g": int(c[1]), "b": int(c[2]), "count": int((points == c).all(1).sum())} for c in centres]
    return sorted([{**r, "percentage": round(100 * r["count"] / len(points), 2)} for r in rows], key=lambda r: -r["count"])


def ellipse(size: int) -> np.ndarray:
    """A structuring element: rows as wide as an ellipse in a square; a cross for 3."""
    r = size // 2
    out = np.zeros((size, size), bool)
    for y in range(size):
        if abs(y - r) <= r:
            reach = int(round(r * np.sqrt(max(0.0, (r * r - (y - r) ** 2) / (r * r))))) if r else 0
            out[y, max(r - reach, 0):min(r + reach + 1, size)] = True
    return out


def _spread(x: np.ndarray, element: np.ndarray, how, outside) -> np.ndarray:
    if element.all() and element.size > 1:  # a rectangle: one axis after the other
        column, line = (np.zeros(element.shape, bool) for _ in (0, 1))
        column[:, element.shape[1] // 2] = line[element.shape[0] // 2] = True
        if not (element == column).all() and not (element == line).all():
            return _spread(_spread(x, column, how, outside), line, how, outside)
    r = element.shape[0] // 2
    p = np.pad(x, [(r, r)] * 2 + [(0, 0)] * (x.ndim - 2), constant_values=outside)
    return how.reduce([p[dy:dy + x.shape[0], dx:dx + x.shape[1]] for dy, dx in zip(*np.nonzero(element))])


def grown(mask: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _spread(mask, element, np.logical_or, False)
    return mask


def shrunk(mask: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _spread(mask, element, np.logical_and, True)
    return mask


def ink(gray: np.ndarray) -> np.ndarray:
    """What is at most the threshold between dark and bright."""
    return gray <= otsu(gray)


def thickened(img: np.ndarray, size: int = 3, times: int = 1) -> np.ndarray:
    """Dark lines grow: the least value of each channel around a pixel; a gray image becomes lines of black on white."""
    if times <= 0:
        return img
    if img.ndim == 2:
        return np.where(grown(ink(img), ellipse(size), times), 0, 255).astype(np.uint8)
    for _ in range(times):
        img = _spread(img, ellipse(size), np.minimum, 255)
    return img


def gaps_closed(img: np.ndarray, size: int = 3) -> np.ndarray:
    """Dark lines grow and shrink again."""
    if img.ndim == 3:
        return _spread(_spread(img, ellipse(size), np.minimum, 255), ellipse(size), np.maximum, 0)
    return np.where(shrunk(grown(ink(img), ellipse(size)), ellipse(size)), 0, 255).astype(np.uint8)


def lines_enhanced(img: np.ndarray, size: int, times: int) -> np.ndarray:
    """Pixels that lines gain become black, the others stay; a gray image becomes lines of black on white."""
    if times <= 0 or img.ndim == 2:
        return thickened(img, size, times)
    lines = ink(to_gray(img))
    out = img.copy()
    out[grown(lines, ellipse(size), times) & ~lines] = 0
    return out


_RGB_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(img: np.ndarray) -> np.ndarray:
    """CIE Lab of a blue-green-red image with sRGB's curve: L in 0 to 100, a and b around 0."""
    c = img[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ _RGB_XYZ.T / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(xyz @ np.linalg.inv(_RGB_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.rint(c[..., ::-1] * 255), 0, 255).astype(np.uint8)


def contrast_enhanced(img: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """CLAHE of a gray image, or of the lightness of a colour one."""
    if img.ndim == 2:
        return clahe(img, clip, grid)
    lab = to_lab(img)
    light = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] += (clahe(light, clip, grid).astype(float) - light) / 2.55
    return from_lab(lab)


def upscaled(img: np.ndarray, factor: int) -> np.ndarray:
    """Larger by a whole factor with a Lanczos kernel of four pixels' reach; edges repeat."""
    if factor <= 1:
        return img
    out = img.astype(np.float64)
    for axis in (0, 1):
        old = out.shape[axis]
        at = (np.arange(old * factor) + 0.5) / factor - 0.5
        low = np.floor(at).astype(int)
        taps = np.arange(-3, 5)
        d = (at - low)[:, None] - taps
        w = np.sinc(d) * np.sinc(d / 4)
        w /= w.sum(1, keepdims=True)
        shape = [-1 if a == axis else 1 for a in range(out.ndim)]
        out = sum(np.take(out, np.clip(low + t, 0, old - 1), axis) * w[:, k].reshape(shape) for k, t in enumerate(taps))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preprocessed(img: np.ndarray, params: dict) -> dict[str, np.ndarray]:
    """The image after each step that its parameters ask for, by the name of the step; the last one is the result."""
    steps = {"original": img}
    if params.get("morph_iterations", 0) > 0:
        img = steps["dilated"] = thickened(img, params.get("morph_kernel_size", 3), params["morph_iterations"])
    if params.get("close_gaps_kernel", 0) > 0:
        img = steps["gaps_closed"] = gaps_closed(img, params["close_gaps_kernel"])
    if params.get("clahe_enabled", False):
        img = steps["clahe"] = contrast_enhanced(img, params.get("clahe_clip_limit", 2.0), params.get("clahe_grid_size", 8))
    if params.get("sharpen_enabled", True):
        steps["sharpened"] = sharpened(img, params.get("sharpen_amount", 1.5))
    return steps


def locally_dark(gray: np.ndarray, block: int = 15, offset: float = 5) -> np.ndarray:
    """What is darker than the Gaussian mean of its block by the offset; edges repeat."""
    sigma, r = 0.3 * ((block - 1) * 0.5 - 1) + 0.8, block // 2
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    mean = gray.astype(float)
    for axis in (0, 1):
        p = np.pad(mean, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = gray.shape[axis]
        mean = sum(w * (p[:, i:i + n] if axis else p[i:i + n]) for i, w in enumerate(k))
    return gray <= np.rint(mean) - offset


def zone_boxes(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes x, y, w, h of what dark frames enclose: local threshold, closed by 7 × 7 twice, outer regions of 1 to 95 % of the image and an aspect of
    at most 8, merged where they overlap by more than half, by (y, x)."""
    from lattica.operators.graph import merge_boxes

    gray = to_gray(img)
    square = np.ones((7, 7), bool)
    closed = shrunk(grown(locally_dark(gray), square, 2), square, 2)
    boxes = [(x, y, w, h) for x, y, w, h, _ in regions(outer(closed))
             if 0.01 * gray.size <= w * h <= 0.95 * gray.size and max(w, h) <= 8 * max(min(w, h), 1)]
    return sorted(merge_boxes(boxes), key=lambda b: (b[1], b[0]))


def crop(img: np.ndarray, x: int, y: int, width: int, height: int, longest: int | None = None) -> np.ndarray:
    """A part of an image; its longer side at most ``longest`` pixels."""
    part = img[y:y + height, x:x + width]
    size = max(part.shape[:2])
    if longest is None or size <= longest:
        return part.copy()
    return resized(part, *(max(1, round(n * longest / size)) for n in (part.shape[1], part.shape[0])))
