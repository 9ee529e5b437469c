"""Main-text extraction from web pages with a recurrent block labeller."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import hash_sample
from sparkprep.llm.html_blocks import Block, leaf_blocks

PATH = 1024       # hashed path parts
WORDS = 32        # hashed words
NUMBERS = 4
HIDDEN = 24
TRAIN_PAGES = 160  # most pages that the labeller is trained on
VARIANTS = 5      # altered copies of each
EPOCHS = 8
SEED = 9
_PAGES = 256      # pages labelled at once

#: Names of containers that hold the main text.
MAIN = ("article", "main", "content", "post", "entry", "story")
#: Names of containers that do not.
ASIDE = ("nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "banner",
         "footer", "copyright", "legal", "aside", "sidebar", "rail", "widget", "related", "recommended", "trending",
         "notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
         "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
         "form", "button", "select", "option", "textarea", "label", "search", "login", "signup",
         "comments", "comment", "discussion", "replies", "reply", "disqus", "respond", "responses",
         "share", "social", "pagination", "pager", "tags", "head", "title")
_PLAIN = ("div", "section", "div", "figure", "center")
_INNER = (("p",), ("p",), ("h2",), ("h3",), ("ul", "li"), ("ul", "li", "a"), ("ol", "li"), ("blockquote", "p"), ("table", "tr", "td"), ("dl", "dd"),
          ("div",), ("pre",), ())


# -- features ---------------------------------------------------------------------

def path_parts(path: Sequence[str]) -> np.ndarray:
    """Buckets of the parts of a tag path; the innermost part once more by itself."""
    parts = {*path, f"^{path[-1]}" if path else "^"}
    return np.unique([zlib.crc32(p.encode()) % PATH for p in parts])


def text_vector(block: Block) -> np.ndarray:
    """Hashed words (root of their shares) and four figures of the block's text."""
    words = block.text.split(" ")
    counts = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
    out = np.empty(WORDS + NUMBERS, np.float32)
    out[:WORDS] = np.sqrt(counts / len(words))
    out[WORDS:] = (np.log1p(len(words)) / 5, min(1.0, block.linked / len(block.text)),
                   sum(block.text.count(c) for c in ".!?") / (1 + len(words)), len(block.text) / len(words) / 10)
    return out


def features(blocks: Sequence[Block]) -> tuple[list[np.ndarray], np.ndarray]:
    return [path_parts(b.path) for b in blocks], np.stack([text_vector(b) for b in blocks])


# -- bidirectional LSTM -------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over padded sequences (time, page, gates); gates: input, forget, output, cell."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int) -> None:
        self.wx = (rng.standard_normal((inputs, 4 * hidden)) * 0.1).astype(np.float32)
        self.wh = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden:2 * hidden] = 1.0
        self.h = hidden

    def forward(self, projected: np.ndarray, keep: list | None = None) -> np.ndarray:
        steps, pages, _ = projected.shape
        n = self.h
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.empty((steps, pages, n), np.float32)
        for t in range(steps):
            z = projected[t] + h @ self.wh + self.b
            gates = _sigmoid(z[:, :3 * n])
            cell = np.tanh(z[:, 3 * n:])
            before, prior = c, h
            c = gates[:, n:2 * n] * c + gates[:, :n] * cell
            squashed = np.tanh(c)
            h = gates[:, 2 * n:] * squashed
            out[t] = h
            if keep is not None:
                keep.append((gates, cell, before, prior, squashed))
        return out

    def backward(self, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the projected inputs and of wh."""
        n = self.h
        d_in, d_wh = np.empty((len(kept), d_out.shape[1], 4 * n), np.float32), np.zeros_like(self.wh)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            gates, cell, before, prior, squashed = kept[t]
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * cell * i * (1 - i), dc * before * f * (1 - f),
                                 dh * squashed * o * (1 - o), dc * i * (1 - cell ** 2)], axis=1)
            d_in[t] = dz
            d_wh += prior.T @ dz
            dh, dc = dz @ self.wh.T, dc * f
        return d_in, d_wh


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every page's own steps in reverse; padding stays at the end."""
    t = np.arange(x.shape[0])[:, None]
    back = np.where(t < lengths, lengths - 1 - t, t)
    return np.take_along_axis(x, back[:, :, None], axis=0)


class Labeller:
    """Main-text probability of every block, from the blocks before and after it."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        size = PATH + WORDS + NUMBERS
        self.ways = [Direction(rng, size, HIDDEN), Direction(rng, size, HIDDEN)]
        self.v = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [p for w in self.ways for p in (w.wx, w.wh, w.b)] + [self.v, self.c]

    def _hidden(self, ahead: np.ndarray, back: np.ndarray, lengths: np.ndarray,
                keeps: tuple = (None, None)) -> np.ndarray:
        a = self.ways[0].forward(ahead, keeps[0])
        b = _flip(self.ways[1].forward(_flip(back, lengths), keeps[1]), lengths)
        return np.concatenate([a, b], axis=2)

    def step(self, names: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of one batch and its gradients (of wx: of the rows
        ``names``, which the columns of ``x`` stand for)."""
        keeps: tuple[list, list] = ([], [])
        hidden = self._hidden(x @ self.ways[0].wx[names], x @ self.ways[1].wx[names], lengths, keeps)
        p = _sigmoid(hidden @ self.v + self.c)
        real = np.arange(len(x))[:, None] < lengths
        n = real.sum()
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * real).sum() / n
        d = ((p - y) * real / n).astype(np.float32)
        d_hidden = d[:, :, None] * self.v
        grads = []
        flat = x.reshape(-1, x.shape[2])
        for k, way in enumerate(self.ways):
            own = d_hidden[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            d_in, d_wh = way.backward(keeps[k], _flip(own, lengths) if k else own)
            d_in = (_flip(d_in, lengths) if k else d_in).reshape(len(flat), -1)
            grads += [flat.T @ d_in, d_wh, d_in.sum(axis=0)]
        return float(loss), [*grads, np.einsum("tp,tph->h", d, hidden), d.sum(keepdims=True).ravel()]

    def train(self, pages: list[tuple[list, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over batches of pages of like length; of wx only the rows in use."""
        rng = np.random.Generator(np.random.PCG64(seed))
        pages = sorted(pages, key=lambda p: len(p[2]))
        batches = [_padded(pages[i:i + 16]) for i in range(0, len(pages), 16)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        t = 0
        for epoch in range(epochs):
            rate = 0.02 * (1 - epoch / epochs) + 1e-3
            for i in rng.permutation(len(batches)):
                t += 1
                _, grads = self.step(*batches[i])
                names = batches[i][0]
                for p, g, (m, s) in zip(self.parameters(), grads, moments):
                    at = names if len(p) == len(self.ways[0].wx) else slice(None)
                    m[at] += 0.1 * (g - m[at])
                    s[at] += 0.01 * (g * g - s[at])
                    p[at] -= (rate * (m[at] / (1 - 0.9 ** t)) / (np.sqrt(s[at] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)

    def label(self, documents: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks are main text, for pages of any lengths."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(documents)
        order = sorted((i for i, d in enumerate(documents) if d), key=lambda i: len(documents[i]))
        both = np.concatenate([w.wx for w in self.ways], axis=1)
        paths: dict[tuple[str, ...], np.ndarray] = {}
        for a in range(0, len(order), 64):
            own = order[a:a + 64]
            lengths = np.array([len(documents[i]) for i in own])
            x = np.zeros((lengths.max(), len(own), both.shape[1]), np.float32)
            for k, i in enumerate(own):
                for t, block in enumerate(documents[i]):
                    if block.path not in paths:
                        if len(paths) > 100_000:
                            paths.clear()
                        paths[block.path] = both[path_parts(block.path)].sum(axis=0)
                    x[t, k] = paths[block.path]
                x[:lengths[k], k] += np.stack([text_vector(b) for b in documents[i]]) @ both[PATH:]
            half = both.shape[1] // 2
            p = _sigmoid(self._hidden(x[:, :, :half], x[:, :, half:], lengths) @ self.v + self.c)
            for k, i in enumerate(own):
                out[i] = p[:lengths[k], k] >= 0.5
        return out


def _padded(pages: list[tuple[list, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(y) for _, _, y in pages])
    used = np.unique(np.concatenate([b for buckets, _, _ in pages for b in buckets]))
    x = np.zeros((lengths.max(), len(pages), len(used) + WORDS + NUMBERS), np.float32)
    y = np.zeros((lengths.max(), len(pages)), np.float32)
    for k, (buckets, texts, labels) in enumerate(pages):
        for t, b in enumerate(buckets):
            x[t, k, np.searchsorted(used, b)] = 1.0
        x[:len(labels), k, len(used):], y[:len(labels), k] = texts, labels
    return np.r_[used, PATH + np.arange(WORDS + NUMBERS)], x, y, lengths


# -- training pages -------------------------------------------------------------------

def known_label(path: Sequence[str]) -> bool:
    """What the names on a path say: inside a main container and no other one."""
    return any(p in MAIN for p in path) and not any(p in ASIDE for p in path)


def _varied(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """A copy of a page under other names, with blocks added that are not main text."""
    def noise() -> list[str]:
        return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 8))) for _ in range(rng.integers(0, 3))]

    def container() -> list[str]:
        name = str(rng.choice(ASIDE))
        tag = [name] if rng.random() < 0.5 else [str(rng.choice(_PLAIN)), *noise(), name]
        return [*tag, *noise()]

    wrap = [str(rng.choice(_PLAIN)), *noise()] if rng.random() < 0.5 else []
    main = str(rng.choice(MAIN))
    main_path = [main] if rng.random() < 0.5 else ["div", *noise(), main]
    texts = [b.text for b in blocks]
    out: list[Block] = []

    def add_aside(base: list[str]) -> None:
        where = [*base, *container()]
        for _ in range(rng.integers(1, 5)):
            text = " ".join(str(rng.choice(texts)).split()[: int(rng.integers(2, 80))])
            inner = _INNER[rng.integers(len(_INNER))]
            out.append(Block(tuple([*where, *inner]), text, len(text) if rng.random() < 0.3 else 0))

    for b in blocks:
        path = list(b.path)
        if rng.random() < 0.06:
            add_aside([*path[:2], *wrap])
        if "article" in path:
            at = path.index("article")
            inner = path[at + 1:] if rng.random() < 0.6 else _INNER[rng.integers(len(_INNER))]
            path = [*path[:at], *wrap, *main_path, *inner]
            if rng.random() < 0.35:
                add_aside([*path[:at], *wrap, *main_path])
        out.append(Block(tuple(path), b.text, b.linked))
    if rng.random() < 0.5:
        add_aside(["html", "body", *wrap])
    return out


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Labeller:
    """A labeller trained on at most ``train_pages`` pages, those of the smallest
    id hash, and altered copies of them; the names on tag paths give the labels."""
    known = hash_sample(pages.where(F.col(html_col).isNotNull()), F.col(id_col), train_pages)
    rows = sorted(known.select(F.col(html_col).cast("string").alias("html")).collect())
    rng = np.random.Generator(np.random.PCG64(SEED))
    documents = []
    for r in rows:
        blocks = leaf_blocks(r["html"])
        if blocks:
            documents += [blocks, *(_varied(blocks, rng) for _ in range(VARIANTS))]
    labeller = Labeller()
    if documents:
        labeller.train([(*features(d), np.array([known_label(b.path) for b in d], np.float32)) for d in documents])
    return labeller


def extract(pages: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, its blocks
    joined by newlines in page order.  Null or empty html gives an empty text;
    repeated rows give equal results; other columns are not read."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(0, batch.num_rows, _PAGES):
                part = batch.slice(i, _PAGES)
                documents = [leaf_blocks(h or "") for h in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, main in zip(d, m) if main) for d, m in zip(documents, labeller.label(documents))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
