"""Main text of HTML pages: a recurrent block labeller over the leaf blocks of a page.

A page is cut into leaf blocks (text between block-level tags; inline markup does not cut), each
with the path of its ancestors (tag names, and words of class, id and role). A block becomes a
vector: a learned embedding of its hashed path words, a learned embedding of its hashed text words,
and five numbers (length, words, share inside links, position, end mark). A bidirectional LSTM in
numpy reads the blocks of the whole page in order, so every decision sees the document on both
sides; a logistic output says main text or not.

Training labels come from structure where it tells: on the pages of a bounded sample that have an
article or main element and on generated ones (menus, notices, adverts, sidebars, forms, reader
comments), a block is main text if such an element holds it and no boilerplate element does. Sampled
pages without one teach nothing. Layouts whose text sits in div, section, table cells or directly in
the body are generated too; their labels are known by construction, not by a tag rule. The model is
small (about 30,000 weights) and is broadcast; each task labels the pages of a batch together,
grouped by length.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import sample_rows

# HTML element names by behaviour.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW_TAGS = ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
ENDS_P = BLOCK_TAGS - frozenset("body html head option optgroup button title caption td th tr tbody thead tfoot li dd dt".split())
# Boilerplate element names, and words of class, id or role that mark boilerplate.
JUNK_TAGS = frozenset("nav header footer aside form button select option menu script style template textarea noscript title head dialog iframe".split())
JUNK_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "header login menu nav navbar navigation newsletter notice notices popup promo promotion related reply replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)

# A tag: quotes count only behind an equals sign; if such a quote swallows the rest of the page, the
# tag ends at the next angle bracket all the same.
_TAG_NAME = r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noframes|xmp)\b([^>]*)>(.*?)(?:</\1\s*[^>]*>|\Z)"
    rf"|{_TAG_NAME}((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|{_TAG_NAME}([^>]*+)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_TAG_START = re.compile("<[A-Za-z/!?]")
#: Elements opened deeper stand beside the last one, as in browsers' parsers.
DEEPEST = 512
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PATH_WORD = re.compile("[a-z]+")
_WORD = re.compile(r"\w+")

_PATHS, _WORDS, _PATH_DIM, _WORD_DIM, _HIDDEN, _NUMBERS = 512, 512, 16, 8, 16, 5


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, references decoded, white space collapsed, empty ones out.
    Broken markup is read like a browser would: unclosed elements end with their parent or with the
    next element that closes them, a tag or comment cut off at the end of the page is markup."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, tuple(w for _, ws in stack for w in ws), linked))
        linked = 0

    def names(tag: str, attributes: str) -> tuple[str, ...]:
        if "=" not in attributes:
            return (tag,)
        marks = (next(x for x in m.groups() if x is not None) for m in _MARK.finditer(attributes))
        return (tag, *dict.fromkeys(f".{w}" for m in marks for w in _PATH_WORD.findall(m.lower())))

    def close(tag: str, among: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag or stack[k][0] in among:
                if any(t in BLOCK_TAGS for t, _ in stack[k:]):
                    flush()
                del stack[k:]
                return
            if among and stack[k][0] in BLOCK_TAGS:
                return

    cut = _TAG_START.search(page, page.rfind(">") + 1)  # a tag that the end of the page cuts off
    for m in _TOKEN.finditer(page if cut is None else page[: cut.start()]):
        raw, raw_attributes, raw_text, slash, tag, attributes, slash_2, tag_2, attributes_2, text = m.groups()
        if tag_2 is not None:
            slash, tag, attributes = slash_2, tag_2, attributes_2
        if text is not None:
            parts.append(text)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(text)
        elif raw is not None:
            raw = raw.lower()
            if raw in ("title", "textarea"):
                flush()
                stack.append((raw, names(raw, raw_attributes)))
                parts.append(raw_text)
                flush()
                stack.pop()
        elif tag is not None:
            tag = tag.lower()
            if slash:
                close(tag)
                continue
            if tag in BLOCK_TAGS:
                flush()
                if tag in ENDS_P:
                    close("p", ("p",))
                if tag in CLOSES:
                    close(tag, CLOSES[tag])
            elif tag == "br":
                parts.append(" ")
            if tag not in VOID_TAGS and not attributes.endswith("/"):
                if len(stack) >= DEEPEST:
                    if stack[-1][0] in BLOCK_TAGS:
                        flush()
                    stack.pop()
                stack.append((tag, names(tag, attributes)))
    flush()
    return out


def structure_label(b: Block) -> int:
    """1 if an article or main element holds the block and no boilerplate element does."""
    held = "article" in b.path or "main" in b.path or ".main" in b.path or ".article" in b.path
    at = max((i for i, w in enumerate(b.path) if w in ("article", "main")), default=0)
    junk = any((w in JUNK_TAGS and (w != "header" or i < at)) or (w[:1] == "." and w[1:] in JUNK_WORDS) for i, w in enumerate(b.path))
    return int(held and not junk)


def _bag(words, size: int) -> list[int]:
    return [zlib.crc32(w.encode()) % size for w in words]


def features(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block: shares of the path buckets, shares of the word buckets, and the numbers."""
    n = len(page)
    path, word, num = (np.zeros((n, k), dtype=np.float32) for k in (_PATHS, _WORDS, _NUMBERS))
    for i, b in enumerate(page):
        at = _bag(dict.fromkeys(b.path), _PATHS)
        path[i] = np.minimum(np.bincount(at, minlength=_PATHS), 1) if at else 0
        w = _bag(_WORD.findall(b.text.lower()), _WORDS)
        if w:
            word[i] = np.bincount(w, minlength=_WORDS) / len(w)
        size = max(len(b.text), 1)
        num[i] = (np.log1p(size) / 6, np.log1p(len(w)) / 4, min(b.link_chars / size, 1.0), (i + 1) / n, b.text[-1:] in ".!?")
    return path, word, num


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM; ``weights`` holds its arrays by name."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        inp, h = _PATH_DIM + _WORD_DIM + _NUMBERS, _HIDDEN
        w = {
            "path": r.normal(0, 0.3, (_PATHS, _PATH_DIM)),
            "word": r.normal(0, 0.3, (_WORDS, _WORD_DIM)),
            "out": r.normal(0, 0.3, 2 * h + inp),
            "out_b": np.zeros(1),
        }
        for d in ("f", "b"):
            w[f"x_{d}"] = r.normal(0, 0.2, (inp, 4 * h))
            w[f"h_{d}"] = r.normal(0, 0.2, (h, 4 * h))
            w[f"g_{d}"] = np.concatenate([np.ones(h), np.zeros(3 * h)])  # forget gates start open
        self.weights = {k: v.astype(np.float32) for k, v in w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """Hidden states (batch, time, h) in reading direction ``d`` and what backpropagation needs."""
        n, t, _ = x.shape
        w, h = self.weights, _HIDDEN
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((n, t, h), np.float32), []
        pre = x @ w[f"x_{d}"] + w[f"g_{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, s] + hid @ w[f"h_{d}"]
            f, i, o, c = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            live = mask[:, s, None]
            new = f * cell + i * c
            th = np.tanh(new)
            kept.append((s, hid, cell, f, i, o, c, th, live))
            cell = np.where(live, new, cell)
            hid = np.where(live, o * th, hid)
            out[:, s] = hid
        return out, kept

    def _forward(self, path, word, num, mask):
        w = self.weights
        x = np.concatenate([path @ w["path"], word @ w["word"], num], axis=2)
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x, mask, "b")
        both = np.concatenate([hf, hb, x], axis=2)
        return x, both, kf, kb, both @ w["out"] + w["out_b"][0]

    def _back(self, d_out, kept, x, d: str, grads) -> np.ndarray:
        w, h = self.weights, _HIDDEN
        d_x = np.zeros_like(x)
        d_hid = np.zeros((len(x), h), np.float32)
        d_cell = np.zeros((len(x), h), np.float32)
        for s, hid, cell, f, i, o, c, th, live in reversed(kept):
            dh = d_hid + d_out[:, s]
            dc = d_cell + np.where(live, dh * o * (1 - th * th), 0)
            dz = np.concatenate([dc * cell * f * (1 - f), dc * c * i * (1 - i), dh * th * o * (1 - o), dc * i * (1 - c * c)], axis=1) * live
            grads[f"x_{d}"] += x[:, s].T @ dz
            grads[f"h_{d}"] += hid.T @ dz
            grads[f"g_{d}"] += dz.sum(axis=0)
            d_x[:, s] = dz @ w[f"x_{d}"].T
            d_hid = np.where(live, dz @ w[f"h_{d}"].T, dh)
            d_cell = np.where(live, dc * f, d_cell)
        return d_x

    def train(self, pages: list[tuple], labels: list[np.ndarray], epochs: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        w = self.weights
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step, h = 0, _HIDDEN
        for _ in range(epochs):
            order = np.array(sorted(range(len(pages)), key=lambda i: (len(labels[i]), rng.random())))
            cuts = [order[i : i + 32] for i in range(0, len(order), 32)]
            for k in rng.permutation(len(cuts)):
                path, word, num, mask = _padded([pages[i] for i in cuts[k]])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(cuts[k]):
                    y[r, : len(labels[i])] = labels[i]
                x, both, kf, kb, z = self._forward(path, word, num, mask)
                err = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
                grads = {n: np.zeros_like(v) for n, v in w.items()}
                grads["out"] = np.tensordot(both, err, axes=([0, 1], [0, 1]))
                grads["out_b"] = err.sum(keepdims=True).reshape(1)
                d_both = err[:, :, None] * w["out"]
                d_x = d_both[:, :, 2 * h :] + self._back(d_both[:, :, :h], kf, x, "f", grads) + self._back(d_both[:, :, h : 2 * h], kb, x, "b", grads)
                grads["path"] = np.tensordot(path, d_x[:, :, :_PATH_DIM], axes=([0, 1], [0, 1]))
                grads["word"] = np.tensordot(word, d_x[:, :, _PATH_DIM : _PATH_DIM + _WORD_DIM], axes=([0, 1], [0, 1]))
                step += 1
                for n, g in grads.items():
                    a, b = state[n]
                    a[:] = 0.9 * a + 0.1 * g
                    b[:] = 0.999 * b + 0.001 * g * g
                    w[n] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
        """Which blocks are main text. Pages of like length run together; ``cells`` bounds the blocks
        of a run (a longer page runs alone)."""
        out = [np.zeros(0, dtype=bool)] * len(pages)
        group: list[int] = []

        def flush() -> None:
            if group:
                path, word, num, mask = _padded([features(pages[i]) for i in group])
                z = self._forward(path, word, num, mask)[-1]
                for r, i in enumerate(group):
                    out[i] = z[r, : len(pages[i])] > 0
                group.clear()

        for i in sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i])):
            if group and (len(group) + 1) * len(pages[i]) > cells:
                flush()
            group.append(i)
        flush()
        return out


def _padded(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    t = max(len(p[0]) for p in pages)
    arrays = [np.zeros((len(pages), t, k), np.float32) for k in (_PATHS, _WORDS, _NUMBERS)]
    mask = np.zeros((len(pages), t), dtype=bool)
    for r, p in enumerate(pages):
        mask[r, : len(p[0])] = True
        for a, x in zip(arrays, p, strict=True):
            a[r, : len(x)] = x
    return (*arrays, mask)


def _makers(rng: np.random.Generator):
    """Makers of words, paragraphs, link lists and boilerplate elements."""
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(400)]
    words = lambda k: " ".join(rng.choice(vocabulary, int(k)))
    para = lambda: f"<p>{words(rng.integers(3, 80)).capitalize()}.</p>"
    links = lambda: "<ul>" + "".join(f"<li><a href='/{words(1)}'>{words(rng.integers(1, 4))}</a></li>" for _ in range(int(rng.integers(2, 9)))) + "</ul>"
    marks = sorted(JUNK_WORDS)

    def junk() -> str:
        mark = str(rng.choice(marks))
        body = str(rng.choice([para(), links(), words(rng.integers(2, 20)), f"<form><label>{words(2)}</label><button>{words(1)}</button></form>"]))
        kind = int(rng.integers(6))
        if kind == 0:
            return f"<nav>{links()}</nav>"
        if kind == 1:
            return f"<aside>{body}</aside>"
        if kind == 2:
            return f"<section id='{mark}'><h3>{words(2)}</h3>{para()}{para()}</section>"
        if kind == 3:
            return f"<form action='/x'><p>{words(4)}</p><button>{words(1)}</button></form>"
        return f"<div class='{mark}{rng.choice(['', ' box', '-wrap', '_1'])}'>{body}</div>"

    return words, para, links, junk


def generated_pages(n: int, seed: int) -> list[str]:
    """Pages of known layout around a main element, with the boilerplate that the samples may lack."""
    rng = np.random.default_rng(seed)
    words, para, links, junk = _makers(rng)

    out = []
    for _ in range(n):
        some = lambda k: "".join(junk() for _ in range(int(rng.integers(0, k))))
        tag = str(rng.choice(["article", "main", "article class='post'"]))
        content = [para() for _ in range(int(rng.integers(1, 12)))]
        content += [f"<h2>{words(4)}</h2>", f"<ul><li>{words(9)}</li><li>{words(5)}</li></ul>", f"<blockquote>{words(12)}</blockquote>"][: int(rng.integers(0, 4))]
        if rng.random() < 0.4:
            content.insert(int(rng.integers(len(content) + 1)), junk())
        head = f"<header><h1>{words(3)}</h1>{links()}</header>" if rng.random() < 0.5 else ""
        foot = f"<footer><p>{words(6)}</p></footer>" if rng.random() < 0.7 else ""
        out.append(
            f"<html><head><title>{words(5)}</title></head><body>{head}{some(4)}<{tag}><h1>{words(6)}</h1>{''.join(content)}"
            f"</{tag.split()[0]}>{some(4)}{foot}</body></html>"
        )
    return out


def generated_layouts(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """(blocks, labels) of pages without article or main: the text is in div, section, a table cell
    or directly in the body. Each block of it is made with a mark, which is taken out again."""
    rng = np.random.default_rng(seed)
    words, _, links, junk = _makers(rng)
    mark = "\ue000"
    names = ["content", "post", "story", "entry", "text", "body", "page", "container", "wrapper", "column", "prose", "copy"]

    def opened() -> tuple[str, str]:
        kind = int(rng.integers(6))
        name = f" {rng.choice(['class', 'id'])}='{rng.choice([*names, words(1)])}{rng.choice(['', '-body', ' wide'])}'" if rng.random() < 0.6 else ""
        if kind < 2:
            return f"<div{name}>", "</div>"
        if kind == 2:
            return f"<div><div{name}>", "</div></div>"
        if kind == 3:
            return f"<section{name}>", "</section>"
        if kind == 4:
            return f"<table><tr><td{name}>", "</td></tr></table>"
        return "", ""

    def sentence() -> str:
        end = str(rng.choice([".", ".", "", "!"])) if rng.random() < 0.5 else "."
        link = f" <a href='/{words(1)}'>{words(2)}</a>" if rng.random() < 0.2 else ""
        return f"{mark}{words(rng.integers(1, 80)).capitalize()}{link}{end}"

    def block() -> str:
        kind = int(rng.integers(9))
        if kind == 0:
            return f"<h{(k := int(rng.integers(1, 4)))}>{mark}{words(rng.integers(1, 8))}</h{k}>"
        if kind == 1:
            return f"<ul><li>{mark}{words(9)}</li><li>{mark}{words(5)}</li></ul>"
        if kind == 2:
            return f"<blockquote>{sentence()}</blockquote>"
        if kind == 3:
            return f"<div>{sentence()}</div>"
        return f"<p>{sentence()}</p>"

    out = []
    for _ in range(n):
        bare = lambda: f"<div>{links()}</div>" if rng.random() < 0.5 else f"<p><a href='/{words(1)}'>{words(3)}</a></p>"
        some = lambda k: "".join(junk() if rng.random() < 0.8 else bare() for _ in range(int(rng.integers(0, k))))
        content = [block() for _ in range(int(rng.integers(1, 12)))]
        if rng.random() < 0.5:
            content.insert(0, f"<h1>{mark}{words(rng.integers(1, 8))}</h1>")
        if rng.random() < 0.1:
            content = [sentence()]  # text without an element of its own
        if rng.random() < 0.4:
            content.insert(int(rng.integers(len(content) + 1)), junk())
        head = f"<header><h1>{words(3)}</h1>{links()}</header>" if rng.random() < 0.5 else ""
        foot = f"<footer><p>{words(6)}</p></footer>" if rng.random() < 0.5 else ""
        a, z = opened()
        page = blocks(f"<html><head><title>{words(5)}</title></head><body>{head}{some(4)}{a}{''.join(content)}{z}{some(4)}{foot}</body></html>")
        labels = np.array([mark in b.text for b in page], np.float32)
        out.append(([Block(b.text.replace(mark, ""), b.path, b.link_chars) for b in page], labels))
    return out


def train_labeller(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 240, generated: int = 480, epochs: int = 6, seed: int = 3,
    layouts: int = 480, page_blocks: int = 400, block_chars: int = 2000,
) -> BlockLabeller:
    """Train on the blocks of ``sample_pages`` pages (smallest hashes of the id, one row each; of each at
    most ``page_blocks`` blocks with at most ``block_chars`` characters; pages without article or main
    left out) and of ``generated`` made ones, labelled by structure, and of ``layouts`` made ones without
    such an element, labelled by construction. These bounds hold for training only."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = blocks(text or "")[:page_blocks]
                yield pa.RecordBatch.from_pydict(
                    {"id": [page] * len(got), "text": [x.text[:block_chars] for x in got], "path": [list(x.path) for x in got], "n": [x.link_chars for x in got]},
                    schema=kind,
                )

    kind = pa.schema([("id", pa.int64()), ("text", pa.string()), ("path", pa.list_(pa.string())), ("n", pa.int64())])
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    rows = sample_rows(rows, "html", sample_pages)
    by: dict[int, list[Block]] = {}
    for r in rows.mapInArrow(extract, "id long, text string, path array<string>, n long").collect():
        by.setdefault(r["id"], []).append(Block(r["text"], tuple(r["path"]), r["n"]))
    told = [by[k] for k in sorted(by) if any(structure_label(b) for b in by[k])]
    made = [(p, np.array([structure_label(b) for b in p], np.float32)) for p in told + [blocks(p) for p in generated_pages(generated, seed)] if p]
    made += generated_layouts(layouts, seed + 1)
    model = BlockLabeller(seed)
    model.train([features(p) for p, _ in made], [y for _, y in made], epochs, seed)
    return model


def html_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **train) -> DataFrame:
    """One row per input row: ``id_col``, ``url_col``, text, n_chars (code points of text).

    Null and empty html gives an empty text; pages are read whole, whatever their length. Null and
    repeated ids are returned as they are. An empty table gives an empty result; other columns are
    ignored."""
    model = pages.sparkSession.sparkContext.broadcast(train_labeller(pages, id_col, html_col, **train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                cut = [blocks(h.as_py() or "") for h in b.column(2)]
                text = ["\n\n".join(x.text for x, keep in zip(p, k, strict=True) if keep) for p, k in zip(cut, model.value.label(cut), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
