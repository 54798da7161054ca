"""HTML extraction: a recurrent block labeller in numpy.

A page is cut into leaf blocks at the borders of block-level elements. Each block is a vector: its
open elements with their classes, ids and roles (hashed), its words (hashed), and a few measures.
A bidirectional LSTM reads the blocks of the page in order, so each label depends on the whole
page; blocks labelled as main text are kept. Character references are decoded, white space in a
block becomes one space, blocks are joined by a line feed; nothing else is dropped or cut.

The network is trained on the driver, once for each run, on pages that a seeded generator makes
(layouts, class names and boilerplate of many kinds with known labels), so no label of the corpus
is needed and the cost does not depend on its size.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes
(unclosed and stray tags, a cut-off end); script, style, title and template contents are never
text; repeated rows each get a row; very long pages are processed whole, their blocks in strips of
``BATCH_BLOCKS`` with the network's state carried on; nesting may be of any depth.
"""

from __future__ import annotations

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PATH, WORDS, HIDDEN = 96, 32, 24
PAGES, EPOCHS, BATCH, RATE, SEED = 1000, 8, 20, 0.015, 5
#: Blocks of pages that are read together, padding included.
BATCH_BLOCKS = 4096

# Elements whose borders end a block, elements without an end tag, elements whose contents are no text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style title template noscript iframe svg math object textarea".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: A quote opens a value only where a value may begin, after an equals sign; anywhere else it is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*)(?:>|\Z)?""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|[0-9]+")


class Open:
    """An open element: its tag, its tokens (tag, classes, id, role), the one around it, and how many tokens there are up to here."""

    __slots__ = ("depth", "sums", "tag", "tokens", "up")

    def __init__(self, tag: str, tokens: tuple[str, ...], up: Open | None):
        self.tag, self.tokens, self.up, self.sums = tag, tokens, up, None
        self.depth = len(tokens) + (up.depth if up else 0)

    def hashed(self) -> np.ndarray:
        """The hashed tokens of this element and all around it, added up; each element adds its own to those of the one around it."""
        todo, at = [], self
        while at is not None and at.sums is None:
            todo.append(at)
            at = at.up
        sums = np.zeros(PATH, np.float32) if at is None else at.sums
        for e in reversed(todo):
            sums = sums.copy()
            for t in e.tokens:
                k, sign = slot(t, PATH)
                sums[k] += sign
            e.sums = sums
        return sums


class Block:
    __slots__ = ("inside", "linked", "text")

    def __init__(self, inside: Open | None, text: str, linked: int):
        self.inside, self.text, self.linked = inside, text, linked

    @property
    def tag(self) -> str:
        return self.inside.tag if self.inside else ""

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.inside
        while at is not None:
            out.append(at.tokens)
            at = at.up
        return tuple(t for tokens in reversed(out) for t in tokens)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page that have text: open elements (as tokens), innermost block element, text, linked characters."""
    out: list[Block] = []
    stack: list[Open] = []
    still: dict[str, int] = {}  # how many of each tag are open, lest a stray end tag search the whole stack
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked, in_link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1] if stack else None, text, linked))
        parts.clear()
        linked, in_link = 0, False

    def pop() -> str:
        tag = stack.pop().tag
        still[tag] -= 1
        return tag

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            linked += (len(page) - at) * in_link
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in SILENT_TAGS:
            if not end and not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag == "a":
            in_link = not end
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if end:
            if still.get(tag):
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1].tag == "p":
            pop()  # a block never stands in a paragraph
        if tag in CLOSES:
            names, limits = CLOSES[tag]
            names = names.split()
            if any(still.get(n) for n in names):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in limits:
                        break
                    if stack[i].tag in names:
                        while len(stack) > i:
                            pop()
                        break
        if tag not in VOID_TAGS:
            named = [p.lower() for a in ATTRIBUTE.finditer(m[3] or "") for p in PART.findall(a[2] or a[3] or a[4] or "")]
            stack.append(Open(tag, (f"<{tag}", *named), stack[-1] if stack else None))
            still[tag] = still.get(tag, 0) + 1
    flush()
    return out


_slot: dict[str, tuple[int, float]] = {}


def slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h >> 20 & 1 else -1.0


MEASURES = 12


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row of PATH + WORDS + MEASURES numbers for each block; the blocks are those from ``first`` on of a page with ``total``."""
    total = len(blocks) if total is None else total
    out = np.zeros((len(blocks), PATH + WORDS + MEASURES), np.float32)
    for i, b in enumerate(blocks):
        if b.inside is not None:
            out[i, :PATH] = np.clip(b.inside.hashed(), -3, 3)
        words = b.text.lower().split()
        n = len(words)
        bag = np.zeros(WORDS, np.float32)
        for w in set(words) if n > 40 else words:
            k, s = slot(w.strip(".,:;!?()\"'"), WORDS)
            bag[k] += s
        out[i, PATH : PATH + WORDS] = bag / np.sqrt(max(n, 1))
        size = len(b.text)
        out[i, PATH + WORDS :] = (
            np.log1p(n) / 3, np.log1p(size) / 5, min(b.linked / size, 1.0), b.text[-1] in ".!?:;…\"", b.tag == "p", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag in ("li", "dd", "dt"), b.tag in ("td", "th"), b.tag == "div", "©" in b.text, (first + i) / total, (b.inside.depth if b.inside else 0) / 20,
        )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + MEASURES
        self.p = {}
        for side in "fb":
            self.p[f"W{side}"] = (rng.standard_normal((d + HIDDEN, 4 * HIDDEN)) / np.sqrt(d / 4)).astype(np.float32)
            self.p[f"c{side}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["u"] = (rng.standard_normal(2 * HIDDEN) / 6).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """x: steps x pages x numbers, in reading order of this side. Padded steps leave the state as it is. ``state`` (h, s) is where to start, and then where it ended."""
        steps, n, d = x.shape
        w, c = self.p[f"W{side}"], self.p[f"c{side}"]
        pre = (x.reshape(-1, d) @ w[:d]).reshape(steps, n, -1) + c
        h, s = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            z = pre[t] + h @ w[d:]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            s2 = f * s + i * g
            m = mask[t][:, None]
            h2 = o * np.tanh(s2)
            if keep is not None:
                keep.append((h, s, i, f, o, g, s2))
            h, s = np.where(m, h2, h), np.where(m, s2, s)
            out[t] = h
        if state is not None:
            state[:] = h, s
        return out

    def label_long(self, blocks: list[Block], strip: int) -> np.ndarray:
        """The probabilities for one page in strips of blocks: vectors and states of one strip at a time, one number a block and direction is kept."""
        total = len(blocks)
        told = np.zeros(total, np.float32)
        for side, u in (("f", self.p["u"][:HIDDEN]), ("b", self.p["u"][HIDDEN:])):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            starts = range(0, total, strip)
            for a in starts if side == "f" else reversed(starts):
                x = vectors(blocks[a : a + strip], a, total)[:, None]
                step = 1 if side == "f" else -1
                told[a : a + strip] += (self.run(x[::step], np.ones(x.shape[:2], bool), side, None, state)[:, 0] @ u)[::step]
        return _sigmoid(told + self.p["d"][0])

    def forward(self, pages: list[np.ndarray], keep=None):
        steps = max(len(v) for v in pages)
        x = np.zeros((steps, len(pages), PATH + WORDS + MEASURES), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for k, v in enumerate(pages):
            x[: len(v), k], mask[: len(v), k] = v, True
        # Backwards, padding comes first and leaves the zero state alone.
        a = self.run(x, mask, "f", keep and keep[0])
        b = self.run(x[::-1], mask[::-1], "b", keep and keep[1])[::-1]
        h = np.concatenate([a, b], -1)
        return x, mask, h, _sigmoid(h @ self.p["u"] + self.p["d"][0])

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of main text for each block of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= BATCH_BLOCKS:
                end += 1
            p = self.forward([pages[k] for k in order[at:end]])[3]
            for c, k in enumerate(order[at:end]):
                out[k] = p[: len(pages[k]), c]
            at = end
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        keep[0].append(None)
        keep[1].append(None)
        x, mask, h, p = self.forward(pages, keep)
        y = np.zeros(mask.shape, np.float32)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        e = np.where(mask, p - y, 0) / mask.sum()
        out = {"u": np.einsum("tn,tnh->h", e, h), "d": np.array([e.sum()], np.float32)}
        for side, past, reverse in (("f", keep[0][1:], False), ("b", keep[1][1:], True)):
            u = self.p["u"][:HIDDEN] if side == "f" else self.p["u"][HIDDEN:]
            xs, ms, es = (v[::-1] if reverse else v for v in (x, mask, e))
            w = self.p[f"W{side}"]
            d = x.shape[2]
            dw, dc = np.zeros_like(w), np.zeros_like(self.p[f"c{side}"])
            dh, ds = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                h0, s0, i, f, o, g, s2 = past[t]
                m = ms[t][:, None]
                dh = dh + es[t][:, None] * u
                th = np.tanh(s2)
                gh, gs = np.where(m, dh, 0), np.where(m, ds, 0)
                gs = gs + gh * o * (1 - th * th)
                dz = np.concatenate([gs * g * i * (1 - i), gs * s0 * f * (1 - f), gh * th * o * (1 - o), gs * i * (1 - g * g)], 1)
                dw[:d] += xs[t].T @ dz
                dw[d:] += h0.T @ dz
                dc += dz.sum(0)
                dh = np.where(m, 0, dh) + dz @ w[d:].T
                ds = np.where(m, gs * f, ds)
            out[f"W{side}"], out[f"c{side}"] = dw, dc
        return out


# What boilerplate is called, and words that stand in it; for the training pages only.
KINDS = {
    "nav": ("nav navbar menu navigation main-menu top-menu breadcrumb breadcrumbs pagination toc".split(), "home about contact products services login register search next previous page".split()),
    "header": ("header site-header masthead top banner branding logo tagline".split(), "welcome news blog official site".split()),
    "footer": ("footer site-footer bottom copyright legal colophon".split(), "copyright rights reserved privacy terms imprint © · all".split()),
    "aside": ("sidebar aside widget related recommended popular trending side rail more-stories".split(), "related popular recommended read also latest posts tags categories archive".split()),
    "notice": ("cookie cookie-notice notice consent gdpr alert banner-message popup modal subscribe-wall warning".split(), "cookies accept agree consent privacy settings subscribe javascript enable browser".split()),
    "ad": ("ad ads advert advertisement sponsored promo promotion ad-slot ad-banner google-ad".split(), "buy now sale offer free sponsored discount shop deal advertisement".split()),
    "form": ("form newsletter signup login search search-form subscribe contact-form".split(), "email password name submit subscribe send search sign up required".split()),
    "comments": ("comments comment reply discussion responses disqus comment-list reader-comments".split(), "comment reply said wrote says posted thanks agree great".split()),
    "share": ("share social share-buttons follow author-box byline meta".split(), "share tweet follow like print email facebook posted by".split()),
}
BODY = "content post entry main article-body post-content story entry-content text body page article single".split()
SYLLABLES = "the an er on re in en at ou is or ti he nd ha es st ing ed th tion ver der ge ein le la de con que ción os é è eau ment ä ö sch ung ra do".split()


def _words(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    text = " ".join(w + (rng.choice(",.;") if rng.random() < 0.08 else "") for w in words)
    if rng.random() < 0.1:  # low-quality prose is main text too
        kind = rng.randrange(4)
        if kind == 0:
            text = " ".join(w + rng.choice(["***", "$$$", "###", "&amp;&amp;&amp;", "%%%"]) for w in text.split())
        elif kind == 1:
            text = " | ".join(text.split()) + " |" * (rng.random() < 0.5)
        elif kind == 2:
            text = "!! ".join(text.upper().split())
        else:
            text = " ".join(w for w in text.split()[: rng.randint(1, 4)] for _ in range(rng.randint(3, 12)))
    return text[:1].upper() + text[1:] + ("." if rng.random() < 0.85 else "")


def _boilerplate(rng: random.Random, kind: str) -> str:
    names, words = KINDS[kind]
    said = lambda lo, hi: " ".join(rng.choice(words) if rng.random() < 0.35 else _words(rng, 1).strip(".") for _ in range(rng.randint(lo, hi)))
    tag = {"nav": ["nav", "div", "ul", "header"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "aside"]}.get(kind, ["div", "section", "aside"])
    t = rng.choice(tag)
    name = rng.choice(names)
    named = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{rng.choice(names)} {name}"']) if t == "div" or t == "section" or rng.random() < 0.5 else ""
    shape = rng.random()
    if kind in ("nav", "aside", "share") and shape < 0.7:
        inner = "<ul>" + "".join(f'<li><a href="/{k}">{said(1, 6)}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"
        if rng.random() < 0.3:
            inner = f"<h3>{said(1, 3)}</h3>" + inner
    elif kind == "comments":
        inner = (f"<h3>{said(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(rng.choice([f'<div class="comment"><p>{_words(rng, rng.randint(3, 50))}</p></div>', f"<p>{_words(rng, rng.randint(3, 50))}</p>", f"<li>{_words(rng, rng.randint(3, 40))}</li>"]) for _ in range(rng.randint(1, 5)))
    elif kind == "form":
        inner = "".join(rng.choice([f"<label>{said(1, 3)}</label><input>", f"<p>{said(2, 10)}</p>", f"<button>{said(1, 2)}</button>", f"<div>{said(1, 6)}</div>"]) for _ in range(rng.randint(1, 4)))
    else:
        text = _words(rng, rng.randint(2, 25)) if rng.random() < 0.6 else said(2, 16)
        if kind == "footer" and rng.random() < 0.7:
            text = "&copy; " + text + " &middot; " + _words(rng, rng.randint(2, 10))
        inner = text if shape < 0.5 else "".join(f"<p>{text}</p>" for _ in range(rng.randint(1, 2)))
    return f"<{t}{named}>{inner}</{t}>"


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, rng.randint(2, 12))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(0, 12) if rng.random() < 0.9 else rng.randint(12, 50)):
        r = rng.random()
        if r < 0.62:
            inner = _words(rng, rng.choice([1, 2, 4, 10, 30, 60, 120]))
            inner = f"<b>{inner}</b>" if rng.random() < 0.1 else inner
            inner = f'{inner} <a href="/x">{_words(rng, 3)}</a> {_words(rng, 6)}' if rng.random() < 0.1 else inner
            parts.append(rng.choice([f"<p>{inner}</p>"] * 5 + [f"<p>{inner}", f"<p><b>{inner}<br>", f"<div>{inner}</div>"]))
        elif r < 0.75:
            parts.append(f"<h{k}>{_words(rng, rng.randint(1, 8))}</h{k}>" if (k := rng.choice([2, 3])) else "")
        elif r < 0.85:
            parts.append("<ul>" + "".join(f"<li>{_words(rng, rng.randint(1, 20))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif r < 0.92:
            parts.append(f"<blockquote>{_words(rng, rng.randint(4, 40))}</blockquote>")
        elif r < 0.96:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 2)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            parts.append(f"<pre>{_words(rng, rng.randint(3, 20))}</pre>")
    return "".join(parts)


#: Marks that carry a training label through the parser.
MAIN, REST = "", ""


def training_page(rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made-up page and their labels."""
    mark = lambda page, m: re.sub(r">(?=[^<]*[^<\s])", ">" + m, page)
    pick = lambda kinds, lo, hi: [mark(_boilerplate(rng, rng.choice(kinds)), REST) for _ in range(rng.randint(lo, hi))]
    before = pick(["nav", "header", "notice", "ad", "form", "share", "aside"], 0, 4)
    if rng.random() < 0.6:
        before.insert(0, mark(_boilerplate(rng, "nav"), REST))
    inside = mark(_article(rng), MAIN)
    if rng.random() < 0.3:  # boilerplate between paragraphs
        cut = [m.end() for m in re.finditer(r"</p>|</ul>|</h1>", inside)]
        for at in sorted(rng.sample(cut, min(len(cut), rng.randint(1, 2))), reverse=True):
            inside = inside[:at] + pick(["ad", "share", "aside", "form", "notice"], 1, 1)[0] + inside[at:]
    if rng.random() < 0.25:
        inside += "".join(pick(["comments", "share", "aside", "ad"], 1, 2))
    name = rng.choice(BODY)
    shell = rng.choice(["<article>%s</article>"] * 4 + ["<main>%s</main>", "<main><article>%s</article></main>", f'<div class="{name}">%s</div>', f'<div id="{name}">%s</div>', f'<article class="{name}">%s</article>', f'<div class="wrap"><div class="{name}">%s</div></div>'])
    after = pick(["comments", "aside", "ad", "share", "form", "notice", "nav"], 0, 4)
    if rng.random() < 0.8:
        after.append(mark(_boilerplate(rng, "footer"), REST))
    page = "<html><head><title>x</title></head><body>" + "".join(before) + (shell % inside.replace("%", "&#37;") if "%" in inside else shell % inside) + "".join(after) + ("</body></html>" if rng.random() < 0.9 else "")
    blocks = blocks_of(page)
    y = np.array([b.text[0] == MAIN for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace(MAIN, "").replace(REST, "").strip() or "x"
    return blocks, y


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = random.Random(seed)
    made = [training_page(rng) for _ in range(pages)]
    data = [(vectors(b), y) for b, y in made if len(b)]
    data.sort(key=lambda v: len(v[1]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    net = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    n, total = 0, epochs * len(batches)
    for _ in range(epochs):
        rng.shuffle(batches)
        for batch in batches:
            n += 1
            rate = RATE * (1 - 0.9 * n / total)
            for k, g in net.gradients([x for x, _ in batch], [y for _, y in batch]).items():
                g = np.clip(g, -1, 1) + 1e-5 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
    return net


def extract(pages: list[str], net: Labeller) -> list[str]:
    """The main text of each page."""
    cut = [blocks_of(p) for p in pages]
    labels = net.label([vectors(b) if 0 < len(b) <= BATCH_BLOCKS else np.zeros((0, 1)) for b in cut])
    labels = [net.label_long(b, BATCH_BLOCKS) if len(b) > BATCH_BLOCKS else p for b, p in zip(cut, labels, strict=True)]
    return ["\n".join(b.text for b, p in zip(blocks, label, strict=True) if p >= 0.5) for blocks, label in zip(cut, labels, strict=True)]


def extract_pages(pages: DataFrame, net: Labeller, step: int = 200, most: int = 1 << 20) -> DataFrame:
    """page_id, url, text of every row of ``pages``; at most ``step`` pages or ``most`` bytes of them at once, or one page."""

    def run(batches):
        for b in batches:
            sizes = np.array([0 if x is None else x for x in pc.binary_length(b.column(2)).to_pylist()])
            a = 0
            while a < b.num_rows:
                n = max(1, min(step, int(np.searchsorted(np.cumsum(sizes[a : a + step]), most, "right"))))
                part = b.slice(a, n)
                a += n
                texts = extract([x or "" for x in part.column(2).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
