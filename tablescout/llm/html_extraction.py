"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads the leaf blocks of a page in order, each as a vector of its tag path
and hashed words, and says for every block whether it is article text, with the whole page as context.

There are no labelled pages, so the training set is made from a bounded sample of the table's own
pages: blocks whose tag path names their role are labelled by it, and the same texts are dressed anew in
other page layouts whose roles are known. After training only the network decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.html_blocks import WIDTH, Block, features, page_blocks

HIDDEN = 16
BATCH_BLOCKS = 16_384
WINDOW = 200

# Words of tag paths that name a role, used to label the sample and to dress new pages.
OTHER_ROLES = {
    "menu": ["nav", "nav .navbar", "nav .menu", "ul .menu", "div .nav", "div .navigation", "div .breadcrumb", "div .breadcrumbs", "div .topbar", "div .pagination", "div .toc"],
    "header": ["header", "header .site .header", "div .header", "div .masthead", "div .branding", "div .page .header"],
    "footer": ["footer", "footer .site .footer", "div .footer", "div .bottom", "div .copyright", "div .colophon"],
    "sidebar": ["aside", "aside .sidebar", "div .sidebar", "div .side", "div .related", "section .related", "div .widget", "div .recommended", "div .trending", "div .rail", "div .secondary"],
    "notice": ["div .cookie .notice", "div .cookie", "div .cookies", "div .notice", "div .consent", "div .gdpr", "div .alert", "div .popup", "div .modal", "div .overlay", "dialog", "section .notice", "div .paywall", "div .disclaimer"],
    "advert": ["div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "div .promo", "div .banner", "div .promotion", "section .ad", "aside .ad", "div .ad .slot", "div .sponsor"],
    "form": ["form", "form .search", "form .newsletter", "div .newsletter", "div .subscribe", "div .login", "form .comment .form", "div .signup", "fieldset", "form .contact"],
    "comments": ["section .comments", "div .comments", "div .comment", "ol .comment .list", "div .disqus", "ul .comments", "div .comment .body", "div .replies", "section .discussion", "div .reader .comments", "div .respond"],
    "share": ["div .share", "div .social", "ul .social", "div .sharing", "div .tags", "div .tools"],
}
ARTICLE_ROLES = [
    "article", "main", "main article", "article .post", "div .article", "div .content", "div .post .content", "div .entry .content",
    "div .article .body", "section .content", "div .main", "div .story", "div .text", "main .content", "div .post", "div .body",
    "article section", "article div .article .body", "main div .entry", "div .page article", "div", "section", "div div", "",
]
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Sport", "Products", "Sign in", "Next page", "Previous", "Log in", "Blog"],
    "header": ["Welcome to our site", "The daily paper", "Menu", "Skip to content", "Our company"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Copyright 2024", "Contact us", "Imprint"],
    "sidebar": ["Related articles", "Most read", "You may also like", "Archive", "Popular posts", "Recent posts"],
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "Please enable JavaScript.", "Subscribe to continue reading."],
    "advert": ["Advertisement", "Buy now!", "Sponsored", "Special offer, only today.", "Click here", "Save 50% now"],
    "form": ["Your name", "Email address", "Submit", "Search", "Subscribe to our newsletter", "Send", "Password"],
    "comments": ["Comments", "Great article, thanks!", "I do not agree with this.", "Reply", "Leave a comment", "3 replies", "posted by guest"],
    "share": ["Share on Facebook", "Tweet", "Share", "Print", "Email this", "Tags"],
}
# Words that say nothing without another one: a page, site or body can hold anything.
GENERIC_WORDS = frozenset((".page", ".site", ".body", ".main", ".text", ".list", ".slot"))


def _elements(path: Iterable[str]) -> list[tuple[str, set[str]]]:
    """(tag, its words) of every element from the root inwards."""
    out: list[tuple[str, set[str]]] = []
    for w in path:
        if not w.startswith("."):
            out.append((w, set()))
        elif out:
            out[-1][1].add(w)
    return out


_OTHER_WAYS = [e for ways in OTHER_ROLES.values() for way in ways for e in _elements(way.split())]
_ARTICLE_WAYS = [e for way in ARTICLE_ROLES for e in _elements(way.split()) if e[0] in ("article", "main") or e[1] - GENERIC_WORDS]


def _fit(ways: list[tuple[str, set[str]]], tag: str, words: set[str]) -> float:
    """Words of the longest way that is whole on the element, -1 without one. `content` counts half:
    a sidebar-content is a sidebar."""
    return max((len(w) - 0.5 * (".content" in w) for t, w in ways if t == tag and w <= words), default=-1.0)


@lru_cache(maxsize=16_384)
def path_label(path: tuple[str, ...]) -> float | None:
    """Label of a tag path by whole ways, tag and words on one element; the innermost element that names
    a role decides, and one that names both (post-footer) leaves it open. A form without a name may span
    a page, so it never makes an article; a header without one belongs to the article around it."""
    form = header = False
    for tag, words in reversed(_elements(path)):
        other, article = _fit(_OTHER_WAYS, tag, words), _fit(_ARTICLE_WAYS, tag, words)
        if other == article:
            if other >= 0:
                return None
        elif article > other:
            return None if form else 1.0
        elif tag == "form" and other == 0:
            form = True
        elif tag == "header" and other == 0:
            header = True
        else:
            return 0.0
    return 0.0 if header else None


def role_label(block: Block) -> float | None:
    """1 article, 0 other, None where the path names no role."""
    return path_label(block.path)


def dressed_page(draw: np.random.Generator, article: list[str], others: list[str]) -> tuple[list[Block], list[float]]:
    """A page of known roles: article blocks in a random container, other roles around and between them."""
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    root = ["html", "body"] + (pick(["", "div", "div .wrapper", "div .container", "div .page", "div .row", "div .site", "div .body", "form"])).split()
    blocks: list[Block] = []
    labels: list[float] = []

    def put(path: list[str], text: str, linked: float, label: float) -> None:
        blocks.append(Block(text, tuple(root + path), linked))
        labels.append(label)

    def other(role: str, inside: list[str]) -> None:
        way = inside + pick(OTHER_ROLES[role]).split()
        for _ in range(int(draw.integers(1, 7))):
            prose = others if role != "comments" or draw.random() < 0.3 else article
            text = pick(PHRASES[role]) if draw.random() < 0.35 else pick(prose)
            link = role in ("menu", "sidebar", "share", "footer") and draw.random() < 0.7
            if link and len(text) > 60:
                text = " ".join(text.split()[:4])
            if role == "menu":
                text = " ".join(text.split()[:2])
            leaf = ["ul", "li"] if role in ("menu", "share") else pick(["p", "div", "", "span", "ul li", "h3", "label"]).split()
            put(way + leaf, text, float(link), 0.0)

    before = ["header", "menu", "notice", "advert", "share", "form", "sidebar"]
    after = ["footer", "sidebar", "comments", "form", "advert", "share", "notice", "menu"]
    for role in before:
        if draw.random() < 0.45:
            other(role, [])
    box = pick(ARTICLE_ROLES).split()
    if draw.random() < 0.7:
        head = box + (["header"] if draw.random() < 0.15 and box and box[-1] == "article" else [])
        put(head + [pick(["h1", "h1", "h2"])], " ".join(pick(article).split()[: int(draw.integers(3, 12))]), 0.0, 1.0)
    for _ in range(int(draw.integers(1, 14))):
        kind = draw.random()
        leaf = ["p"] if kind < 0.6 else pick(["h2", "h3", "blockquote p", "ul li", "ul li", "ol li", "pre", "div", "table tr td", "", "figure figcaption"]).split()
        text = pick(article)
        if leaf[-1:] and leaf[-1] in ("li", "h2", "h3", "td") and draw.random() < 0.6:
            text = " ".join(text.split()[: int(draw.integers(1, 9))])
        put(box + leaf, text, 0.0 if draw.random() < 0.9 else float(draw.random()) * 0.3, 1.0)
        if draw.random() < 0.07:
            other(pick(["advert", "share", "sidebar", "notice", "form"]), box)
    if draw.random() < 0.2:
        other("comments", box)
    for role in after:
        if draw.random() < 0.45:
            other(role, [])
    return blocks, labels


class BiLSTM:
    """Bidirectional LSTM with one logistic output per step; parameters in float32."""

    def __init__(self, seed: int = 42, width: int = WIDTH, hidden: int = HIDDEN):
        draw = np.random.default_rng(seed)
        self.h = hidden
        scale = lambda *s: (draw.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = scale(width, 4 * hidden), scale(hidden, 4 * hidden)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1.0  # forget gates start open
        self.p["o"], self.p["co"] = scale(2 * hidden, 1), np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (steps, pages, width), mask: (steps, pages). Padding leaves the state as it is."""
        steps, pages, _ = x.shape
        h = self.h
        inputs = x @ self.p["x" + d] + self.p["c" + d]
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, trace = np.zeros((steps, pages, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + state @ self.p["h" + d]
            gates = 1.0 / (1.0 + np.exp(-z[:, : 3 * h]))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                trace.append((t, i, f, o, g, th, cell, state, m))
            cell, state = np.where(m, new, cell), np.where(m, o * th, state)
            out[t] = state
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return (out @ self.p["o"] + self.p["co"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Back-propagation through time of the weighted mean log loss."""
        h, grads = self.h, {}
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        out = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        z = (out @ self.p["o"] + self.p["co"])[..., 0]
        dz = ((1.0 / (1.0 + np.exp(-z)) - y) * weight / max(1.0, weight.sum())).astype(np.float32)
        grads["o"] = (out * dz[..., None]).sum(axis=(0, 1))[:, None]
        grads["co"] = np.array([dz.sum()], np.float32)
        back = dz[..., None] * self.p["o"][:, 0]
        for k, d in enumerate("fb"):
            dout, dh_w = back[..., k * h : (k + 1) * h], self.p["h" + d].T
            dzs = np.zeros(x.shape[:2] + (4 * h,), np.float32)
            ds = np.zeros((x.shape[1], h), np.float32)
            dc, gh = np.zeros_like(ds), np.zeros_like(self.p["h" + d])
            for t, i, f, o, g, th, cell, state, m in reversed(runs[d][1]):
                ds = ds + dout[t]
                do, dnew = ds * th, dc + ds * o * (1 - th * th)
                step = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1) * m
                dzs[t] = step
                gh += state.T @ step
                ds, dc = np.where(m, step @ dh_w, ds), np.where(m, dnew * f, dc)
            grads["h" + d] = gh
            grads["x" + d] = x.reshape(-1, x.shape[2]).T @ dzs.reshape(-1, 4 * h)
            grads["c" + d] = dzs.sum(axis=(0, 1))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 42):
        """Adam over pages(features, labels, weights); blocks of weight 0 are context only."""
        order = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        step = 0
        for epoch in range(epochs):
            lr = rate * (1.0 if epoch < epochs * 0.6 else 0.3)
            for b in order.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[b]])
                y, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for j, i in enumerate(batches[b]):
                    y[: len(pages[i][1]), j], weight[: len(pages[i][2]), j] = pages[i][1], pages[i][2]
                step += 1
                for k, g in self.gradients(x, mask, y, weight).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), WIDTH), np.float32), np.zeros((steps, len(rows)), bool)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, True
    return x, mask


def train(pages: DataFrame, max_pages: int = 300, max_bytes: int = 100_000, dressed: int = 5, seed: int = 42) -> BiLSTM:
    """Fits the labeller on up to `max_pages` pages of at most `max_bytes`, chosen by hash, each also
    dressed `dressed` times anew (the page itself weighs three times as much). All blocks of a sampled page are learned, long pages in windows of WINDOW blocks
    whose features are those of the whole page. Only the fit is bounded so; extraction reads every whole page."""
    usable = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") <= max_bytes))
    ids = [r[0] for r in usable.select("page_id").orderBy(F.xxhash64(F.lit(seed), "page_id"), "page_id").limit(max_pages).collect()]
    few = pages.sparkSession.createDataFrame([(i,) for i in ids], "page_id long")
    rows = usable.join(F.broadcast(few), "page_id", "left_semi").select("page_id", "html").limit(2 * max_pages).collect()
    read = [page_blocks(r.html) for r in sorted(rows, key=lambda r: (r.page_id, r.html))]
    model, data = BiLSTM(seed), []
    article = [b.text for p in read for b in p if role_label(b) == 1.0] or [b.text for p in read for b in p if len(b.text) > 40]
    others = [b.text for p in read for b in p if role_label(b) == 0.0] or [w for words in PHRASES.values() for w in words]
    if not article:
        article = others
    for blocks in (p for p in read if p):
        labels = [role_label(b) for b in blocks]
        x, y = features(blocks), np.array([y or 0.0 for y in labels], np.float32)
        weight = 3 * np.array([y is not None for y in labels], np.float32)
        for at in range(0, len(blocks), WINDOW):
            data.append((x[at : at + WINDOW], y[at : at + WINDOW], weight[at : at + WINDOW]))
    draw = np.random.default_rng(seed)
    for _ in range(dressed * max(len(read), 1) if len(read) else 0):
        blocks, labels = dressed_page(draw, article, others)
        data.append((features(blocks), np.array(labels, np.float32), np.ones(len(labels), np.float32)))
    if data:
        model.fit(data, seed=seed)
    return model


def label_pages(model: BiLSTM, pages: list[list[Block]]) -> list[np.ndarray]:
    """True for article blocks of every page; pages of like length run through the network together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        steps, group = 0, []
        while order and (not group or max(steps, len(pages[order[0]])) * (len(group) + 1) <= BATCH_BLOCKS):
            group.append(order.pop(0))
            steps = len(pages[group[-1]])
        x, mask = padded([features(pages[i]) for i in group])
        logits = model.logits(x, mask)
        for j, i in enumerate(group):
            out[i] = logits[: len(pages[i]), j] > 0
    return out


def extract(pages: DataFrame, model: BiLSTM, html: str = "html") -> DataFrame:
    """Adds text and n_chars to every row and drops the html; columns named like a result are replaced.

    text joins the article blocks in page order with one empty line between them. Null, empty and
    textless pages give an empty text and 0; repeated rows are read each."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    keep = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars", html)], F.col(html).alias("_html"))
    schema = keep.drop("_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                blocks = [page_blocks(h.as_py()) for h in batch.column(batch.schema.get_field_index("_html"))]
                texts = [
                    "\n\n".join(b.text for b, ok in zip(page, label) if ok)
                    for page, label in zip(blocks, label_pages(fitted, blocks))
                ]
                rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_html"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names
                )

    return keep.mapInArrow(run, schema)
