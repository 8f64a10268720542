"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in order. Each block is a vector: embeddings, summed, of the hashed names and
classes on its tag path and of its hashed words, and a few lengths. A bidirectional LSTM in numpy runs over
the sequence of blocks, so the label of each, text or not, follows from the whole page. The labeller is trained
here, on pages that ``sample_page`` writes in many layouts together with their labels.
"""

from __future__ import annotations

import html.parser
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, table

# HTML's elements that stand as blocks, that have no end tag, and whose content is never text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg iframe textarea".split())
# Open elements that a start tag of the key ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P = BLOCKS - frozenset("button label option legend select summary".split())

PATHS, WORDS = 1 << 14, 1 << 13
PATH_DIM, WORD_DIM, LENGTHS, HIDDEN = 20, 8, 5, 20
EVEN = 24
#: Pages of the training sample and passes over it.
SAMPLE, EPOCHS, SEED = 2000, 14, 11


class _Blocks(html.parser.HTMLParser):
    """Collects (tag path, text, characters in links) of leaf blocks. The path is a tuple of (tag, class and id words)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.unread: list[str] = []
        self.hidden: list[str] = []  # blocks that have begun within what is not read
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[tuple[tuple, str, int]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((tuple(x for x in self.open if x[0] in BLOCKS), text, self.linked))
        self.parts, self.linked = [], 0

    def _end(self, names) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in ("ul", "ol", "dl", "table", "article", "section", "body"):
                return

    def handle_starttag(self, tag, attrs):
        if self.unread and self.unread[-1] == "svg" and tag in BLOCKS and tag != "title":
            self.unread, self.hidden = [], []  # a drawing has no blocks: it was not closed
        if tag in UNREAD:
            self.unread.append(tag)
            return
        if self.unread:
            if tag in BLOCKS and tag not in VOID:
                self.hidden.append(tag)
            return
        if tag == "br":
            self.parts.append("\n")
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSED_BY:
                self._end(CLOSED_BY[tag])
            elif tag in NO_P:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == "p":
                        del self.open[i:]
                        break
                    if self.open[i][0] in BLOCKS:
                        break
        if tag == "a":
            self.links += 1
        if tag not in VOID:
            named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
            self.open.append((tag, tuple(re.findall(r"[a-z]+", named))))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in UNREAD:
            if tag in self.unread:
                del self.unread[len(self.unread) - 1 - self.unread[::-1].index(tag) :]
            if not self.unread:
                self.hidden = []
            return
        if self.unread:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
                return
            if tag not in BLOCKS or all(tag != name for name, _ in self.open):
                return
            self.unread, self.hidden = [], []  # the block around it ends, and with it what was not closed
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.links = max(0, self.links - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                break

    def handle_data(self, data):
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(page: str | None) -> list[tuple[tuple, str, int]]:
    """Leaf blocks in page order, white space within each made one space; character references are decoded."""
    reader = _Blocks()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.found


@lru_cache(maxsize=1 << 16)
def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=4096)
def _path_ids(path: tuple) -> tuple[int, ...]:
    """Names of the leaf, its parent and those above, apart; and the two nearest tags together."""
    near = " ".join(tag for tag, _ in path[-2:])
    out = [_bucket(f"near <{near}>", PATHS)]
    for depth, (tag, names) in enumerate(reversed(path)):
        where = ("own", "parent", "above")[min(depth, 2)]
        out.append(_bucket(f"{where} <{tag}>", PATHS))
        out += [_bucket(f"{where} .{n}", PATHS) for n in names]
    return tuple(dict.fromkeys(out))  # each once, however often it nests


def vectors(blocks: list[tuple[tuple, str, int]]) -> tuple[list, list, np.ndarray]:
    """Per block: ids of its path, ids of all its words, and lengths."""
    paths, words, lengths = [], [], np.zeros((len(blocks), LENGTHS), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        paths.append(_path_ids(path))
        words.append([_bucket(w, WORDS) for w in re.findall(r"\w+|\S", text.lower())])
        n = len(text)
        lengths[i] = np.log1p(n) / 8, min(1.0, linked / n), text[-1] in ".!?…", (i + 1) / len(blocks), 1.0 / (1 + i)
    return paths, words, lengths


def _scale(lens: np.ndarray) -> np.ndarray:
    """What sums of so many embeddings are divided by: the root, and past EVEN in proportion, so that long texts weigh no more."""
    lens = np.maximum(lens, 1)
    return (lens / np.minimum(lens, EVEN) ** 0.5)[:, None]


def _bag(ids: list, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled sum of embeddings of each list of ids, with the flat ids and whose they are."""
    lens = np.array([len(x) for x in ids])
    of = np.repeat(np.arange(len(ids)), lens)
    flat = np.fromiter((y for x in ids for y in x), np.int64, lens.sum())
    out = np.zeros((len(ids), table_.shape[1]), np.float32)
    np.add.at(out, of, table_[flat])
    return out / _scale(lens).astype(np.float32), flat, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTMs and a logistic output; ``p`` holds all weights."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + LENGTHS
        self.p = {"path": r.normal(0, 0.05, (PATHS, PATH_DIM)), "word": r.normal(0, 0.02, (WORDS, WORD_DIM)), "out": r.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.p[f"x{side}"] = r.normal(0, d**-0.5, (d, 4 * HIDDEN))
            self.p[f"h{side}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"b{side}"] = b
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _padded(self, pages: list) -> tuple:
        lens = np.array([len(p[0]) for p in pages])
        top = int(lens.max())
        e_path, path_ids, path_of = _bag([x for p in pages for x in p[0]], self.p["path"])
        e_word, word_ids, word_of = _bag([x for p in pages for x in p[1]], self.p["word"])
        flat = np.concatenate([e_path, e_word, np.concatenate([p[2] for p in pages])], 1)
        row = np.concatenate([np.arange(n) for n in lens])
        column = np.repeat(np.arange(len(pages)), lens)
        x = np.zeros((top, len(pages), flat.shape[1]), np.float32)
        x[row, column] = flat
        mask = np.zeros((top, len(pages), 1), np.float32)
        mask[row, column] = 1
        return x, mask, row, column, (path_ids, path_of, word_ids, word_of)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        top, n, _ = x.shape
        gates_x = x @ self.p[f"x{side}"] + self.p[f"b{side}"]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((top, n, HIDDEN), np.float32)
        for t in range(top) if side == "f" else range(top - 1, -1, -1):
            z = gates_x[t] + h @ self.p[f"h{side}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            y = np.tanh(c_new)
            m = mask[t]
            if keep is not None:
                keep.append((t, i, f, o, g, c, y, h, m))
            c, h = m * c_new + (1 - m) * c, m * (o * y) + (1 - m) * h
            out[t] = h
        return out

    def logits(self, pages: list) -> list[np.ndarray]:
        x, mask, row, column, _ = self._padded(pages)
        both = np.concatenate([self._run(x, mask, s) for s in "fb"], 2)
        z = both @ self.p["out"] + self.p["bias"][0]
        return [z[: len(p[0]), j] for j, p in enumerate(pages)]

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        x, mask, row, column, (path_ids, path_of, word_ids, word_of) = self._padded(pages)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, s, kept[s]) for s in "fb"], 2)
        z = both @ self.p["out"] + self.p["bias"][0]
        want = np.zeros_like(z)
        want[row, column] = np.concatenate(labels)
        prob = _sigmoid(z)
        total = mask.sum()
        loss = -float((mask[:, :, 0] * (want * np.log(prob + 1e-7) + (1 - want) * np.log(1 - prob + 1e-7))).sum() / total)
        dz = mask[:, :, 0] * (prob - want) / total
        grad = {"out": np.einsum("tb,tbh->h", dz, both), "bias": np.array([dz.sum()], np.float32)}
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            d_out = dz[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            wh, wx = self.p[f"h{side}"], self.p[f"x{side}"]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            gh, gates = np.zeros_like(wh), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, i, f, o, g, c, y, h, m in reversed(kept[side]):
                dh = dh + d_out[t]
                d_new, c_new = m * dh, m * dc
                dct = c_new + d_new * o * (1 - y * y)
                dg = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), d_new * y * o * (1 - o), dct * i * (1 - g * g)], 1)
                gates[t] = dg
                gh += h.T @ dg
                dh = (1 - m) * dh + dg @ wh.T
                dc = (1 - m) * dc + dct * f
            grad[f"h{side}"] = gh
            grad[f"b{side}"] = gates.sum((0, 1))
            grad[f"x{side}"] = np.einsum("tbd,tbg->dg", x, gates, optimize=True)
            dx += gates @ wx.T
        flat = dx[row, column]
        for name, ids, of, a, b in (("path", path_ids, path_of, 0, PATH_DIM), ("word", word_ids, word_of, PATH_DIM, PATH_DIM + WORD_DIM)):
            lens = _scale(np.bincount(of, minlength=len(flat)))
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], ids, (flat[:, a:b] / lens)[of])
        return loss, grad

    def label(self, pages: list) -> list[np.ndarray]:
        """Which blocks are text, page by page. Pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p[0]), key=lambda i: len(pages[i][0]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and upto - at < 64 and len(pages[order[upto]][0]) <= 1.5 * len(pages[order[at]][0]) + 4:
                upto += 1
            some = order[at:upto]
            for i, z in zip(some, self.logits([pages[i] for i in some])):
                out[i] = z > 0
            at = upto
        return out


# Layouts of the training pages. Names are common ones of the web's templates; ``_odd`` makes others.
TEXT_NAMES = "content article-body post post-body entry-content story main-content hentry article text body-text page-content blog-post news-item rich-text prose".split()
NEUTRAL = "container wrapper inner outer row col col-md-8 grid layout block region page site section box panel node field clearfix view module main-wrap template root app".split()
MENUS = "main-menu menu navbar breadcrumb pagination nav navigation toc topnav submenu pager breadcrumbs".split()
HEADERS = "site-header header topbar masthead page-header top brand".split()
FOOTERS = "site-footer footer copyright legal bottom colophon credits".split()
SIDES = "sidebar related widget recommended share social tags side-column most-read trending teaser see-also promo-list author-links".split()
NOTICES = "cookie-notice notice cookie-banner alert banner consent popup newsletter paywall gdpr modal subscribe signup toast".split()
ADVERTS = "ad ads advert advertisement promo sponsored banner-ad ad-slot adsense dfp ad-container sponsor commercial".split()
COMMENTS = "comments comment-list commentlist disqus replies discussion responses comment-section reader-comments".split()
FORMS = "search login signup-form contact-form subscribe-form comment-form poll".split()
SAID = {
    "menu": "home about contact news blog archive search login menu next previous help products services sport world business",
    "footer": "copyright all rights reserved privacy terms imprint contact policy conditions company powered by",
    "notice": "we use cookies accept subscribe sign up to our newsletter privacy policy continue browser consent agree settings free",
    "ad": "sponsored buy now offer sale shop advertisement discount order today only deal click here",
    "comment": "reply says posted comment comments like report user said on thanks great ago",
    "form": "name email message send submit subscribe search password your address comment post",
    "side": "related popular recent posts share follow tags more read tweet facebook most latest also",
    "byline": "by written updated published on editor staff min read posted author reporter",
}
SYLLABLES = "the on er in at re ti an st ed es ha ou le de en la que ci on mi ra ca to se un ge be ver ch ung al is or ea th ing ly wh nt".split()
#: Words that stand anywhere, those of the boxes among them: one alone tells nothing.
ORDINARY = "the of and to in is was for that with as his her on by at from he she they had not but this which were all one been have their said who will when can would there two no out up into only its after over year years day old little again until before down back town house water people river hills said made went took told three last first small great long under between evening morning".split() + " ".join(SAID.values()).split()
#: Where the text of a page stands; an accuracy is held out by leaving some of them out of training.
FAMILIES = ("article", "main", "section", "div", "bare", "cell", "odd", "nested", "headed", "nameless")


def _phrase(r: np.random.Generator, n: int) -> str:
    made = ["".join(SYLLABLES[i] for i in r.integers(0, len(SYLLABLES), r.integers(1, 5))) for _ in range(n)]
    kind = r.integers(0, 12)
    if kind > 5:
        spoken = r.random(n) < 0.5
        made = [str(r.choice(ORDINARY)) if x else w for x, w in zip(spoken, made)]
    if kind == 0:
        made = [w.upper() + "!!" for w in made]
    elif kind == 1:
        made = [w + str(r.choice(["***", "###", "%%%", "&&&", ",", "$$$"])) for w in made]
    elif kind == 2:
        made = [made[0]] * n
    between = str(r.choice([" | ", " / ", " - ", " \u00b7 ", ", ", " # "])) if kind == 3 else " "
    text = between.join(made)
    return (text[:1].upper() + text[1:] + ("." if r.random() < 0.8 else "")).replace("&", "&amp;")


class _Page:
    """A page in the making: parts of its html, and the label of each leaf block."""

    def __init__(self, r: np.random.Generator, family: str):
        self.r, self.family = r, family
        self.out: list[str] = []
        self.labels: list[int] = []
        #: How many of a page's names say nothing, and whether it has names at all.
        self.strange, self.named = float(r.choice([0.0, 0.3, 0.7])), family != "nameless" and r.random() < 0.9
        #: Habits of a page: what its paragraphs are, and how often an end tag that may be missing is.
        self.paragraph, self.unclosed = ("p", "div")[r.random() < 0.12], 0.05 if r.random() < 0.85 else 0.95

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def one(self, options):
        return options[self.r.integers(0, len(options))]

    def odd(self) -> str:
        made = "-".join("".join(self.one(SYLLABLES) for _ in range(self.r.integers(1, 4))) for _ in range(self.r.integers(1, 4)))
        return self.one([made, made, made + str(self.r.integers(0, 99)), self.one(NEUTRAL), "js-" + made, "css-" + made])

    def start(self, tag: str, name: str = "") -> str:
        """Opens an element, under its name, one that says nothing, both or none; returns what closes it."""
        names = [name] if name and self.named else []
        if self.named and self.chance(self.strange):
            names.insert(self.r.integers(0, len(names) + 1), self.odd())
        kind = "id" if self.chance(0.2) else "class"
        self.out.append(f"<{tag}" + (f' {kind}="{" ".join(names)}"' if names else "") + ">")
        return f"</{tag}>"

    def within(self, tag: str, name: str, fill) -> None:
        end = self.start(tag, name)
        fill()
        self.out.append(end)

    def said(self, kind: str, n: int) -> str:
        words = SAID[kind].split()
        at = int(self.r.integers(0, len(words)))
        return " ".join((words[at:] + words[:at])[:n] if self.chance(0.5) else self.r.choice(words, n))

    def leaf(self, tag: str, n: int, label: int, said: str = "", link: bool = False, name: str = "") -> None:
        text = _phrase(self.r, n)
        if said and self.chance(0.6):
            text = self.said(said, min(n, int(self.r.integers(2, 7)))) + ("" if n < 6 else " " + text)
        style = self.r.random()
        if link:
            text = f'<a href="/x">{text}</a>' if style < 0.7 else f"{_phrase(self.r, 1)} <a href='/y'>{text}</a>"
        elif label and style < 0.1 and n > 8:
            text += f' <a href="/z">{_phrase(self.r, 2)}</a> {_phrase(self.r, 3)}'
        elif style < 0.25:
            text = self.one([f"<b>{text}</b>", f"<b>{text}<br>" if tag == "p" else f"<em>{text}</em>", f"<span>{text}</span>", f"{text}<svg><title>t</title><path d='M0'/></svg>"])
        end = self.start(tag, name)
        self.out.append(text + ("" if tag in ("p", "li", "dt", "dd") and self.chance(self.unclosed) else end))
        self.labels.append(label)

    def bare(self, n: int, said: str) -> None:
        self.out.append((self.said(said, 3) + " " if self.chance(0.6) else "") + _phrase(self.r, n))
        self.labels.append(0)

    def links(self, said: str, n: int, most: int = 3) -> None:
        """A list of links, in a list or one after another in blocks or items of their own."""
        tag = self.one(["ul", "ul", "ol", "div"])
        end = self.start(tag)
        for _ in range(n):
            self.leaf("li" if tag != "div" else self.one(["div", "p", "h4"]), int(self.r.integers(1, most + 1)), 0, said, True)
        self.out.append(end)

    def menu(self) -> None:
        if self.chance(0.15):  # links in one block
            self.within(self.one(["nav", "div", "p"]), self.one(MENUS), lambda: (self.out.append(self.one([" | ", " ", " &middot; ", " / "]).join(f'<a href="/{i}">{_phrase(self.r, 1)}</a>' for i in range(self.r.integers(2, 7)))), self.labels.append(0)))
        elif self.chance(0.2):
            self.links("menu", int(self.r.integers(3, 9)), 2)
        else:
            self.within(self.one(["nav", "nav", "div"]) if self.named else "nav", self.one(MENUS), lambda: self.links("menu", int(self.r.integers(2, 9)), 2))

    def box(self, tags: list[str], names: list[str], said: str, most: int = 3) -> None:
        """A box of something else; one without a telling tag has a telling name, or links or telling words."""

        def fill() -> None:
            kind = self.r.random()
            if kind < 0.4:
                self.bare(int(self.r.integers(2, 25)), said)
            elif kind < 0.6 and said in ("side", "ad", "footer"):
                if self.chance(0.6):
                    self.leaf(self.one(["h2", "h3", "h4"]), 2, 0, said)
                self.links(said, int(self.r.integers(2, 7)), 9)
            else:
                for _ in range(self.r.integers(1, most + 1)):
                    self.leaf(self.one(["p", "h3", "p", "div", "li", "button"]), int(self.r.integers(1, 30)), 0, said, self.chance(0.3))

        tags = [t for t in tags if t not in ("div", "section")] or tags
        tag = self.one(tags) if not self.named else self.one([*tags, "div", "section"])
        if tag in ("div", "section") and not self.named:  # nothing but its words tells
            self.within(tag, "", lambda: (self.out.append(" ".join(self.said(said, 6).split()) + "."), self.labels.append(0)))
            return
        deep = self.chance(0.3)
        self.within(tag, self.one(names), (lambda: self.within("div", "", fill)) if deep else fill)

    def form(self) -> None:
        def fill() -> None:
            for _ in range(self.r.integers(1, 4)):
                self.leaf(self.one(["label", "p", "button", "div", "legend"]), int(self.r.integers(1, 6)), 0, "form")
            self.out.append(self.one(["<input name='q'>", "<textarea>type</textarea>", ""]))

        self.within("form", self.one(FORMS), fill)

    def comments(self) -> None:
        def one() -> None:
            for _ in range(self.r.integers(0, 2)):
                self.leaf(self.one(["h4", "div", "p", "h5"]), 2, 0, "comment", name=self.one(["author", "comment-author", "meta", "user"]))
            self.leaf(self.one(["p", "p", "div", "blockquote"]), int(self.r.integers(2, 60)), 0, "comment" if self.chance(0.4) else "")
            if self.chance(0.2):
                self.within("div", self.one(["replies", "children", "comment"]), lambda: self.leaf("p", int(self.r.integers(2, 40)), 0))
            if self.chance(0.3):
                self.leaf(self.one(["div", "p", "button"]), 1, 0, "comment", True)

        def fill() -> None:
            if self.chance(0.5):
                self.leaf(self.one(["h2", "h3"]), int(self.r.integers(1, 4)), 0, "comment")
            tag = self.one(["div", "li", "article", "div"])
            outer = self.start("ol") if tag == "li" else ""
            for _ in range(self.r.integers(1, 6)):
                self.within(tag, self.one(["comment", "reply", "comment-body", "response"]), one)
            self.out.append(outer)
            if self.chance(0.2):
                self.form()

        kept, self.named = self.named, True  # what readers write is text too: only its names tell it
        self.within(self.one(["section", "div", "div", "aside"]), self.one(COMMENTS), fill)
        self.named = kept

    def around(self, p: float) -> None:
        parts = [self.menu, lambda: self.box(["aside"], SIDES, "side"), lambda: self.box(["dialog"], NOTICES, "notice"), lambda: self.box(["aside"], ADVERTS, "ad"), self.form]
        for i in self.r.permutation(len(parts)):
            if self.chance(p):
                parts[i]()

    def top(self) -> None:
        if self.chance(0.15):
            self.out.append('<a href="#c">Skip to content</a>')
            self.labels.append(0)
            self.out.append("<hr>")
        if self.chance(0.6):

            def fill() -> None:
                self.leaf(self.one(["h1", "div", "p", "h2"]), int(self.r.integers(1, 6)), 0, link=self.chance(0.4))
                if self.chance(0.2):
                    self.leaf(self.one(["p", "div"]), int(self.r.integers(2, 9)), 0)
                if self.chance(0.6):
                    self.menu()
                if self.chance(0.2):
                    self.form()

            self.within(self.one(["header", "header", "div"]) if self.named else "header", self.one(HEADERS), fill)
        if self.chance(0.6):
            self.menu()
        self.around(0.25)

    def bottom(self) -> None:
        self.around(0.2)
        if self.chance(0.85):

            def fill() -> None:
                if self.chance(0.5):
                    self.out.append(self.one(["&copy; ", "&copy; 2024 ", "(c) "]))
                    self.bare(int(self.r.integers(2, 15)), "footer")
                elif self.chance(0.4):
                    self.links("footer", int(self.r.integers(2, 7)))
                else:
                    self.leaf("p", int(self.r.integers(2, 15)), 0, "footer", self.chance(0.3))

            self.within(self.one(["footer", "footer", "div"]) if self.named else "footer", self.one(FOOTERS), fill)
        elif self.chance(0.3):
            self.out.append(f"<p>&copy; {self.said('footer', 5)}</p>")
            self.labels.append(0)

    def heading(self) -> None:
        def title() -> None:
            self.leaf("h1" if self.chance(0.85) else "h2", int(self.r.integers(1, 12)), 1, name=self.one(["", "", "title", "headline", "entry-title"]))

        def byline() -> None:
            for _ in range(self.r.integers(1, 3)):
                self.leaf(self.one(["p", "div", "p", "address"]), int(self.r.integers(2, 7)), 1, "byline", self.chance(0.2), self.one(["byline", "author", "meta", "date", "dateline", "lead", ""]))

        if self.family == "headed" or self.chance(0.15):
            self.within(self.one(["header", "header", "div", "hgroup"]), self.one(["", "entry-header", "article-header", "post-header"]), lambda: (title(), byline() if self.chance(0.7) else None))
        elif self.chance(0.85):
            title()
            if self.chance(0.3):
                byline()
            if self.chance(0.1):
                self.box(["aside"], ["share", "social", "share-buttons"], "side", 2)

    def prose(self) -> None:
        r = self.r
        long = r.random()
        for _ in range(int(r.integers(40, 90)) if long < 0.03 else int(r.integers(1, 16))):
            kind = r.random()
            if kind < 0.62:
                # A paragraph may speak as a footer or a notice does.
                said = self.one(list(SAID)) if self.chance(0.07) else ""
                self.leaf(self.paragraph if self.chance(0.95) else "div", int(r.integers(1, 60)), 1, said, self.chance(0.03))
            elif kind < 0.7:
                self.leaf(self.one(["h2", "h3", "h4"]), int(r.integers(1, 8)), 1)
            elif kind < 0.81:
                most = int(self.one([3, 20]))
                self.within(self.one(["ul", "ol"]), "", lambda most=most: [self.leaf("li", int(r.integers(1, most)), 1, link=self.chance(0.1)) for _ in range(r.integers(1, 6))])
            elif kind < 0.84:
                self.within("blockquote", "", lambda: self.leaf("p", int(r.integers(3, 30)), 1)) if self.chance(0.5) else self.leaf("blockquote", int(r.integers(3, 30)), 1)
            elif kind < 0.86:
                self.within("figure", "", lambda: (self.out.append("<img src='a.png'>"), self.leaf("figcaption", int(r.integers(2, 14)), 1)))
            elif kind < 0.875:
                self.within("table", "", lambda: [self.within("tr", "", lambda: [self.leaf(self.one(["td", "td", "th"]), int(r.integers(1, 5)), 1) for _ in range(2)]) for _ in range(r.integers(1, 5))])
            elif kind < 0.885:
                self.within("dl", "", lambda: [self.leaf(t, int(r.integers(1, 9)), 1) for _ in range(r.integers(1, 4)) for t in ("dt", "dd")])
            elif kind < 0.9:
                self.leaf("pre", int(r.integers(2, 30)), 1)
            elif kind < 0.925:
                self.within("section", "", lambda: (self.leaf("h2", 3, 1), self.leaf("p", int(r.integers(5, 40)), 1), self.leaf("p", int(r.integers(2, 40)), 1)))
            elif kind < 0.95:
                self.box(["aside"], ADVERTS, "ad", 2)
            elif kind < 0.97:
                self.box(["dialog"], NOTICES, "notice", 2)
            elif kind < 0.985:
                self.box(["aside"], SIDES, "side", 2)
            else:
                self.form()

    def text(self) -> None:
        def fill() -> None:
            self.heading()
            self.prose()
            if self.chance(0.1):
                self.comments()

        family = self.family
        if family == "bare":
            fill()
            return
        if family == "cell":  # a table for the layout: links in one cell, the text in another
            row = self.start("table") and self.start("tr")
            if self.chance(0.6):
                self.within("td", self.one(["", *MENUS[:3]]), lambda: self.links("menu", int(self.r.integers(2, 7)), 2))
            self.within("td", self.one(["", "", *TEXT_NAMES]), fill)
            self.out.append(row + "</table>")
            return
        tag, name = {
            "article": ("article", self.one(["", "", *TEXT_NAMES])), "main": ("main", self.one(["", "", "content", "main-content"])), "section": ("section", self.one(["", *TEXT_NAMES])),
            "div": ("div", self.one(TEXT_NAMES)), "odd": (self.one(["div", "div", "section"]), self.odd()), "nested": ("div", ""), "headed": (self.one(["article", "article", "main", "div"]), self.one(["", *TEXT_NAMES])), "nameless": (self.one(["div", "article", "main", "section"]), ""),
        }[family]
        ends = [self.start(self.one(["div", "div", "section", "main"]), self.one(["", self.odd(), self.one(NEUTRAL)])) for _ in range(self.r.integers(0, 4) if family == "nested" else self.r.integers(0, 2))]
        end = self.start(tag, name)
        if family == "nested":
            ends.append(end)
            end = self.start("div", self.one(["", self.odd(), *TEXT_NAMES[:4]]))
        fill()
        self.out.append(end + "".join(reversed(ends)))


def sample_page(r: np.random.Generator, families: tuple[str, ...] = FAMILIES) -> tuple[str, list[int]]:
    """A page in a random layout and, for each of its leaf blocks in order, 1 for text and 0 for the rest."""
    page = _Page(r, families[r.integers(0, len(families))])
    page.out.append("<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + _phrase(r, 6) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head>")
    page.labels.append(0)
    page.start("body")
    wrapped = page.start("div", page.one(NEUTRAL)) if page.family != "bare" and page.chance(0.3) else ""
    page.top()
    page.text()
    if page.chance(0.3):
        page.comments()
    page.bottom()
    page.out.append(wrapped + ("</body></html>" if page.chance(0.9) else ""))
    return "".join(page.out), page.labels


def training_pages(n: int = SAMPLE, seed: int = SEED, families: tuple[str, ...] = FAMILIES) -> tuple[list, list[np.ndarray]]:
    r = np.random.default_rng(seed)
    pages, labels = [], []
    while len(pages) < n:
        page, want = sample_page(r, families)
        found = blocks_of(page)
        if len(found) == len(want):  # a missing end tag may join blocks; such pages have no labels
            pages.append(vectors(found))
            labels.append(np.array(want, np.float32))
    return pages, labels


@lru_cache(maxsize=2)
def trained(n: int = SAMPLE, epochs: int = EPOCHS, seed: int = SEED, families: tuple[str, ...] = FAMILIES) -> Labeller:
    """The labeller after ``epochs`` of Adam over ``n`` pages, its weights averaged over the last third of the steps. A tenth
    of the path names is left out at each step, and the words of half of the blocks, so that neither tells all."""
    pages, labels = training_pages(n, seed, families)
    net, r = Labeller(seed), np.random.default_rng(seed + 1)
    m, v, mean = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(3))
    step, size = 0, 40
    last = epochs * -(-n // size)
    averaged = 0
    for epoch in range(epochs):
        order = sorted(range(n), key=lambda i: (len(pages[i][0]) // 6, r.random()))
        batches = [order[i : i + size] for i in range(0, n, size)]
        r.shuffle(batches)
        for batch in batches:
            thin = [([[y for y in x if r.random() > 0.1] or x for x in pages[i][0]], [x if r.random() > 0.5 else [] for x in pages[i][1]], pages[i][2]) for i in batch]
            _, grad = net.gradients(thin, [labels[i] for i in batch])
            step += 1
            rate = 0.02 * (1 - step / last) + 0.002
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            if 3 * step >= 2 * last:
                averaged += 1
                for k, w in net.p.items():
                    mean[k] += (w - mean[k]) / averaged
    net.p = mean
    return net


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Text blocks in page order, joined by one line break. Null or empty html, and pages without a text block, give
    empty text; a long page is read whole. Each row is read by itself, so repeated rows get equal results; null ids and
    urls stay null; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    net = spark.sparkContext.broadcast((labeller or trained()).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Labeller()
        mine.p = net.value
        for batch in batches:
            found = [blocks_of(page) for page in batch.column("html").to_pylist()]
            labels = mine.label([vectors(b) for b in found])
            texts = ["\n".join(text for (_, text, _), keep in zip(b, some) if keep) for b, some in zip(found, labels)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars bigint")


def op1_html(spark, sf_dir: str) -> DataFrame:
    """extract() over whole ``pages``; its docstring says what null, empty and repeated rows give."""
    return extract(table(spark, sf_dir, "pages"))
