"""A recogniser and a renderer for tests: text is drawn as coloured cells, and read back by their colours, at any scale, from left to right only."""

import numpy as np

CELL, TALL, MARK = 6, 10, 200


def draw(page: np.ndarray, text: str, x: int, y: int, turned: bool = False) -> None:
    """Writes text at (x, y); turned: upwards, as on pages that are read after a turn clockwise."""
    cells = np.zeros((TALL, CELL * len(text), 3), np.uint8)
    for k, ch in enumerate(text):
        cells[:, k * CELL : (k + 1) * CELL] = (33 + k % 2, MARK, ord(ch))
    cells = np.rot90(cells, 1) if turned else cells
    page[y : y + cells.shape[0], x : x + cells.shape[1]] = cells


def ring(page: np.ndarray, cx: int, cy: int, r: int) -> None:
    y, x = np.mgrid[0 : page.shape[0], 0 : page.shape[1]]
    page[np.abs(np.hypot(x - cx, y - cy) - r) <= 2] = 0


class Recogniser:
    def words(self, width, height, data, mode):
        pixels = np.frombuffer(data, np.uint8).reshape(height, width, -1)
        inked = (pixels[:, :, 1] == MARK) & ((pixels[:, :, 0] == 33) | (pixels[:, :, 0] == 34))
        open_, out = {}, []
        for y in range(height + 1):
            here = {}
            xs = np.flatnonzero(inked[y]) if y < height else np.zeros(0, int)
            for run in np.split(xs, np.flatnonzero(np.diff(xs) > 1) + 1) if len(xs) else []:
                row = pixels[y, run]
                new = np.ones(len(run), bool)
                new[1:] = row[1:, 0] != row[:-1, 0]
                text = "".join(map(chr, row[new, 2]))
                key = (text, int(run[0]) // 4, int(run[-1]) // 4)
                here[key] = open_.pop(key, (text, int(run[0]), y, int(run[-1]) + 1))
            out += [(text, float(x0), float(y0), float(x1), float(y), 90.0) for (text, x0, y0, x1) in open_.values() if y - y0 >= 3]
            open_ = here
        return iter(sorted(out, key=lambda w: (w[2], w[1])))


class Renderer:
    """Documents are ``%PDF-``, the side of a square page, and its pixels at scale 1."""

    def _page(self, content):
        side = int.from_bytes(content[5:9], "big")
        return np.frombuffer(content[9:], np.uint8).reshape(side, side, 3)

    def pages(self, content, scale):
        page = self._page(content)
        k = int(scale)
        big = np.repeat(np.repeat(page, k, axis=0), k, axis=1)
        yield 1, big.shape[1], big.shape[0], big.tobytes()

    def region(self, content, page, box, scale):
        pixels = self._page(content)
        x, y, w, h = box
        n = max(1, int(round(w * scale)))
        at = lambda start, size: np.floor(start + (np.arange(n) + 0.5) / n * size).astype(int)
        xs, ys = at(x, w), at(y, h)
        out = np.full((n, n, 3), 255, np.uint8)
        ox, oy = (xs >= 0) & (xs < pixels.shape[1]), (ys >= 0) & (ys < pixels.shape[0])
        out[np.ix_(oy, ox)] = pixels[np.ix_(ys[oy], xs[ox])]
        return n, n, out.tobytes()


def document(page: np.ndarray) -> bytes:
    return b"%PDF-" + page.shape[0].to_bytes(4, "big") + page.tobytes()
