"""Operator 3: main text of web pages by sum-product message passing on the DOM tree.

A page is parsed into a tree of block elements with its text runs as leaves; inline markup stays inside its
run. Every node has a hidden label, content or not. A node's own potential comes from its features (tag and
name class; for a run its length, its share of link text, its ending, its kind of block, words that head boxes) and a
parent-child potential, one 2 x 2 table for each class of child, ties the labels along the tree. Messages go
up and down once, level by level and for many pages at a time, and give the exact content marginal of every
run; runs at 0.5 or more are the text. The weights maximise the likelihood of labelled pages, which are
generated by rule (articles in many page frames, with or without a header of their own, with menus, notices, adverts,
forms, comments and so on, also in boxes that only their words tell, and pages of a few bare blocks);
the gradient is the observed minus the expected feature count, from the same message passing.

Blocks: a run's character references are decoded, its white space becomes single spaces, and runs are joined
by an empty line in page order. Script, style and comments never make runs.

Defined results: a null html counts as empty and gives the empty text; repeated rows give repeated results;
broken markup (open tags, stray ends, cut-off tags) is read as browsers do in the plain cases; very deep and
very long pages are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm._spark import table

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*)(?:(?>\"[^\"]*\"|'[^']*')(?>[^>\"']*))*|[^>]*)(?:>|\Z))", re.DOTALL)
NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "ruby", "rt", "rp", "center"} | (VOID - {"hr"})
#: An opening tag of the key ends the open elements of its value, up to the nearest boundary.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main", "aside", "nav", "footer", "header", "form"}

MAIN_TAGS = {"article", "main"}
FRAME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "fieldset"}
MAIN_NAME = re.compile(r"(?:^|[-_ ])(?:article|articlebody|content|post|entry|story|main|text|body)(?:$|[-_ ])", re.IGNORECASE)
FRAME_NAME = re.compile(r"(?:^|[-_ ])(?:nav\w*|menu\w*|side(?:bar)?|ads?|advert\w*|sponsor\w*|banner\w*|cookies?|consent|notices?|comments?|respon[ds]\w*|repl(?:y|ies)|footer|header|masthead|promo\w*|related|share\w*|social|subscri\w+|newsletter|breadcrumbs?|popup|modal|widget\w*|login|search\w*|toolbar|pagination|pager|alert\w*|disclaimer|copyright|complementary|navigation|contentinfo|toc|tags?|meta)(?:$|[-_ ])", re.IGNORECASE)
#: What heads or fills boxes that are no article, where neither tag nor name tells.
FRAME_WORDS = re.compile(r"^\W*\d*\W*(?:comment|kommentar|comentario|commentaire|repl(?:y|ies)|respon[ds]|leave a|related|read (?:more|also|next)|more from|subscribe|sign up|newsletter|advert|sponsor|share|follow us|imprint|impressum|mentions l.gales|aviso legal|copyright|©|\(c\)|all rights)", re.IGNORECASE)
FRAME_PHRASE = re.compile(r"newsletter|all rights reserved|alle rechte|tous droits|todos los derechos|cookies|imprint|impressum", re.IGNORECASE)
ROOT, MAIN, FRAME, NEUTRAL, SECTION, PARAGRAPH, HEADING, ITEM, RUN, OPENING = range(10)  # OPENING: the header of a main element
CLASSES = 10
#: Features of runs follow the classes: length (5), link share (4), ending (2), words of frames in a short run (2); then one of roots and neutral elements whose page has no main element.
FEATURES = CLASSES + 14


def classify(tag: str, attributes: str, within_main: bool = False) -> int:
    if tag in ("html", "body"):  # their names tell of the layout
        return NEUTRAL
    if tag == "header" and within_main:
        return OPENING
    if tag in FRAME_TAGS:
        return FRAME
    named = " ".join(x for found in NAMES.findall(attributes) for x in found if x) if attributes and "=" in attributes else ""
    if named and FRAME_NAME.search(named):
        return FRAME
    if tag in MAIN_TAGS or (named and MAIN_NAME.search(named)):
        return MAIN
    if tag in ("p", "blockquote", "pre", "figcaption"):
        return PARAGRAPH
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return HEADING
    if tag in ("li", "td", "th", "dd", "dt"):
        return ITEM
    return SECTION if tag in ("section", "div") else NEUTRAL


@dataclass
class Tree:
    """Parents and feature ids of the nodes, in page order; texts of the runs."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [ROOT])
    extra: list[tuple[int, int, int, int] | None] = field(default_factory=lambda: [None])
    runs: dict[int, str] = field(default_factory=dict)

    def add(self, parent: int, kind: int, extra: tuple[int, int, int, int] | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.extra.append(extra)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    tree, stack = Tree(), [("", 0)]
    pieces: list[str] = []
    links = [0, 0]  # open links, characters in links
    lower = None

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            words, share = text.count(" ") + 1, links[1] / len(text)
            extra = (min(4, (words > 2) + (words > 5) + (words > 12) + (words > 25)), (share > 0) + (share > 0.4) + (share > 0.8), int(text[-1] in ".!?:;\"')»…"), int(words <= 12 and bool(FRAME_WORDS.search(text) or FRAME_PHRASE.search(text))))
            tree.runs[tree.add(stack[-1][1], RUN, extra)] = text
        links[1] = 0

    def text(raw: str) -> None:
        if raw:
            decoded = entities.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if links[0]:
                links[1] += len(decoded.strip())

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not closing and not (attributes or "").endswith("/"):
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == n else "".join(c.lower() if c.isascii() else c for c in page)
                end = lower.find("</" + tag, at)
                at = n if end < 0 else max(at, lower.find(">", end) + 1 or n)
            continue
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        links[0] = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        ends = IMPLIED.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in BOUNDARY:
                    break
        while stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (stack[-1][0] == "p" or tag == "p"):
            stack.pop()  # a block ends an open paragraph
        if tag in ("body", "html") and any(name == tag for name, _ in stack):
            continue
        if tag == "body":
            stack[:] = [s for s in stack if s[0] != "head"]
        within = tag == "header" and next((tree.kind[x] == MAIN for _, x in reversed(stack) if tree.kind[x] in (MAIN, FRAME)), False)
        node = tree.add(stack[-1][1], classify(tag, attributes or "", within))
        if tag != "hr" and not (attributes or "").endswith("/"):
            stack.append((tag, node))
    flush()
    return tree


class Forest:
    """The nodes of many pages as arrays, by level."""

    def __init__(self, trees: list[Tree]):
        base = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.base = base
        self.parent = np.concatenate([np.array(t.parent) + b for t, b in zip(trees, base, strict=False)] or [np.zeros(0, int)])
        depth = np.concatenate([np.array(t.depth) for t in trees] or [np.zeros(0, int)])
        self.kind = np.concatenate([np.array(t.kind) for t in trees] or [np.zeros(0, int)])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.features = np.zeros((len(self.kind), FEATURES))
        self.features[np.arange(len(self.kind)), self.kind] = 1
        run = np.flatnonzero(self.kind == RUN)
        extra = np.array([e for t in trees for e in t.extra if e is not None], dtype=int).reshape(-1, 4)
        for column, start in enumerate((CLASSES, CLASSES + 5, CLASSES + 9, CLASSES + 11)):
            self.features[run, start + extra[:, column]] = 1
        page = np.repeat(np.arange(len(trees)), np.diff(base))
        bare = np.bincount(page[self.kind == MAIN], minlength=len(trees)) == 0
        self.features[:, FEATURES - 1] = bare[page] & np.isin(self.kind, (ROOT, NEUTRAL)) if len(page) else 0
        # what a paragraph or heading is, its run is: its class comes as a second class feature
        held = run[np.isin(self.kind[self.parent[run]], (PARAGRAPH, HEADING, ITEM))]
        self.features[held, self.kind[self.parent[held]]] = 1


class TreeModel:
    """Node weights (for content) and a table of pair weights for each class of child."""

    def __init__(self) -> None:
        self.node = np.zeros(FEATURES)
        self.pair = np.zeros((CLASSES, 2, 2))

    def infer(self, f: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """Node marginals (n, 2), pair marginals (n, parent label, own label) and the log partition sum."""
        n = len(f.kind)
        own = np.zeros((n, 2))
        own[:, 1] = f.features @ self.node
        pair = self.pair[f.kind]
        inside, up = own.copy(), np.zeros((n, 2))
        for level in reversed(f.levels[1:]):
            both = inside[level][:, None, :] + pair[level]
            up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(inside, f.parent[level], up[level])
        roots = f.levels[0] if f.levels else np.zeros(0, int)
        total = np.logaddexp(inside[roots, 0], inside[roots, 1]).sum()
        outside, pairs = np.zeros((n, 2)), np.zeros((n, 2, 2))
        belief = inside.copy()
        for level in f.levels[1:]:
            above = belief[f.parent[level]] - up[level]  # all that the parent knows but from this child
            joint = above[:, :, None] + pair[level] + inside[level][:, None, :]
            top = joint.max((1, 2), keepdims=True)
            p = np.exp(joint - top)
            pairs[level] = p / p.sum((1, 2), keepdims=True)
            down = above[:, :, None] + pair[level]
            outside[level] = np.logaddexp(down[:, 0, :], down[:, 1, :])
            belief[level] = inside[level] + outside[level]
        marginal = np.exp(belief - np.logaddexp(belief[:, :1], belief[:, 1:]))
        return marginal, pairs, float(total)

    def fit(self, f: Forest, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> None:
        m, v, n = [0, 0], [0, 0], len(f.base) - 1
        child = np.concatenate(f.levels[1:])
        seen_node = f.features.T @ labels
        seen_pair = np.zeros_like(self.pair)
        np.add.at(seen_pair, (f.kind[child], labels[f.parent[child]], labels[child]), 1)
        for t in range(1, rounds + 1):
            marginal, pairs, _ = self.infer(f)
            expected = np.zeros_like(self.pair)
            np.add.at(expected, f.kind[child], pairs[child])
            for i, (w, g) in enumerate(((self.node, (seen_node - f.features.T @ marginal[:, 1]) / n - decay * self.node), (self.pair, (seen_pair - expected) / n - decay * self.pair))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w += rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)


def labelled_pages(n: int = 700, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(html, content runs) generated by rule; content words start with an upper-case X mark that runs keep."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    ends = "."
    sentence = lambda a=4, b=30: words(a, b).capitalize() + r.choice(ends)
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

    def menu() -> str:
        tag, name = r.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' id="nav"'), ("div", ' class="main-menu"'), ("ul", ' class="breadcrumb"'), ("div", ' role="navigation"')])
        return f"<{tag}{name}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(1, 8))) + f"</ul></{tag}>"

    def boxed(kind: str) -> str:
        frames = {
            "ad": [("div", ' class="ad"'), ("div", ' class="ads box"'), ("aside", ' class="advert"'), ("section", ' class="sponsored"'), ("div", ' id="banner-top"')],
            "notice": [("div", ' class="cookie-notice"'), ("div", ' id="consent"'), ("div", ' class="notice"'), ("section", ' class="alert"'), ("dialog", "")],
            "side": [("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="side"'), ("section", ' class="related"'), ("div", ' class="widget"')],
            "comments": [("div", ' class="comments"'), ("section", ' id="comments"'), ("div", ' class="comment-list"'), ("ol", ' class="comments"')],
            "header": [("header", ""), ("div", ' id="header"'), ("div", ' class="masthead"')],
            "footer": [("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"')],
            "form": [("form", ""), ("form", ' class="search"'), ("div", ' class="newsletter"')],
        }
        tag, name = r.choice(frames[kind])
        inner = {
            "ad": lambda: sentence(2, 40) if r.random() < 0.6 else f"<p>{sentence(3, 20)}</p>{link()}",
            "notice": lambda: f"<p>{sentence(5, 30)}</p>{r.choice(['', '<button>ok</button>'])}",
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + "".join(r.choice([f"<p>{sentence()}</p>", f"<ul><li>{link()}</li></ul>"]) for _ in range(r.randint(1, 3))),
            "comments": lambda: "".join(r.choice([f'<div class="comment"><p>{sentence(3, 40)}</p></div>', f"<li><p>{word()}: {sentence(3, 40)}</p></li>", f"<p>{sentence(3, 60)}</p>"]) for _ in range(r.randint(1, 4))),
            "header": lambda: r.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(1, 5)}</p>", menu()]),
            "footer": lambda: r.choice([f"&copy; {words(1, 4)} &middot; {sentence(3, 40)}", f"<p>{sentence(3, 40)}</p>", f"{link()} | {link()}"]),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{sentence(3, 12)}</p>",
        }[kind]()
        return f"<{tag}{name}>{inner}</{tag}>"

    def nameless(kind: str) -> str:
        """A box that only its words tell: comments, a newsletter, related pages, an imprint."""
        tag, item = r.choice(["div", "section"]), lambda: r.choice(["<p>{}</p>", "<div>{}</div>"]).format(sentence(3, 30))
        said = {"comments": ["3 comments", "Comments", "12 Kommentare", "Leave a reply", "2 responses"], "ad": ["Advertisement", "Sponsored"], "side": ["Related", "Read more", "More from us", "Subscribe to our newsletter", "Follow us"]}
        if kind == "footer":
            return f"<{tag}>{r.choice(['Imprint', '© 2020', 'Copyright', 'All rights reserved', 'Impressum'])} {words(1, 5)}{r.choice(['', '.'])}</{tag}>"
        head = r.choice(["h2", "h3", "h4", "p", "div"])
        fill = "<ul>" + "".join(f"<li>{sentence(3, 30) if kind == 'comments' else link()}</li>" for _ in range(r.randint(1, 4))) + "</ul>" if r.random() < 0.5 else "".join(item() for _ in range(r.randint(1, 3)))
        return f"<{tag}><{head}>{r.choice(said[kind])}</{head}>{fill}</{tag}>"

    out = []
    for _ in range(n):
        body: list[str] = []
        content: list[str] = []
        ends, longest = r.choice([".....!,", ".....!,", "|", " ", "!"]), r.choice([1, 2, 3, 8, 8, 8, 40])
        least, most = r.choice([(1, 5), (1, 5), (1, 2), (4, 30), (20, 60)])

        def say(text: str, content: list[str] = content) -> str:
            content.append("X" + text)
            return "X" + text

        for kind, often in (("header", 0.4), ("menu", 0.7), ("notice", 0.3), ("ad", 0.5)):
            if r.random() < often:
                body.append(menu() if kind == "menu" else boxed(kind))
        r.shuffle(body)
        open_tag, name = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post"'), ("section", ' class="entry-content"'), ("div", ' itemprop="articleBody"'), ("div", ' class="story"')])
        parts = []
        title = f"<h1>{say(words(2, 12))}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.35:  # the article's own header, with a line below the title
            line = r.choice([None, None, "p", "div", "span"])
            title = f"<header{r.choice(['', ' class=entry-header', ' class="post-header"'])}>{title}{f'<{line}>{say(words(2, 6))}</{line}>' if line else ''}</header>"
        parts.append(title)
        for _ in range(r.randint(1, longest)):
            kind = r.random()
            if kind < 0.66:
                parts.append(f"<p>{say(' '.join(sentence(least, most) for _ in range(r.randint(1, 5))))}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.72:
                parts.append(f"<h2>{say(words(1, 6))}</h2>")
            elif kind < 0.78:
                parts.append("<ul>" + "".join(f"<li>{say(sentence(2, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.82:
                parts.append(f"<blockquote><p>{say(sentence(5, 30))}</p></blockquote>")
            elif kind < 0.86:
                parts.append(f"<div><p>{say(sentence(5, 30))}</p></div>")
            elif kind < 0.89:
                parts.append(f"<p>{say(sentence(2, 12))} <a href=/x>{words(1, 4)}</a></p>")
            elif kind < 0.92:
                parts.append(f"<table><tr><td>{say(words(1, 6))}</td><td>{say(words(1, 3))}</td></tr></table>")
            else:
                parts.append(boxed(r.choice(["ad", "side", "notice", "form"])))
        if r.random() < 0.08:  # no frame at all
            if not content:
                parts.append(f"<p>{say(sentence(8, 40))}</p>")
            out.append(("".join(parts) if r.random() < 0.5 else f"<html><body>{''.join(parts)}</body></html>", content))
            continue
        if r.random() < 0.08:  # the body is the article
            out.append((f"<html><head><title>{word()}</title></head><body>{''.join([*body, *parts])}{boxed('footer')}</body></html>", content))
            continue
        if r.random() < 0.25:
            parts.append(boxed("comments"))
        main = f"<{open_tag}{name}>" + "".join(parts) + f"</{open_tag}>"
        if r.random() < 0.4:
            main = f'<div class="{r.choice(["wrap", "page", "row", "container"])}">{main}{boxed("side") if r.random() < 0.5 else ""}</div>'
        body.append(main)
        for kind, often in (("side", 0.3), ("comments", 0.4), ("ad", 0.2), ("footer", 0.8)):
            if r.random() < often:
                body.append(nameless(kind) if r.random() < 0.25 else boxed(kind))
        out.append((f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>x='<p>'</script></head><body>" + "".join(body) + r.choice(["</body></html>", ""]), content))
    return out


def plain_pages(n: int = 700, seed: int = 8) -> list[str]:
    """Pages without any frame around their one to three blocks, and pages that have frames only; content runs start with an upper-case X."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(1, 9)))
    say = lambda: "X" + " ".join(word() for _ in range(r.choice([1, 2, 4, 8, 15, 40]))) + r.choice(["", ".", "!"])
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    block = lambda tag: f"<{tag}>{say()}" + (f" {link()}" if r.random() < 0.1 else "") + f"</{tag}>"
    frames = [lambda: f"<nav><ul><li>{link()}</li></ul></nav>", lambda: f"<footer>{word()} {word()}.</footer>", lambda: f'<div class="comments"><p>{word()} {word()}.</p></div>', lambda: f"<form><label>{word()}</label><input></form>", lambda: f'<div class="ad">{word()}</div>', lambda: f"<aside><p>{word()} {word()}</p></aside>"]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.1:
            body = say()
        elif kind < 0.4:  # a short article without a frame, with a link or a box in it
            tag, box = r.choice(["article", "article", "main"]), r.choice(["", f"<p>{link()}</p>", f"<p>{link()}</p>", f'<aside class="related">{link()}</aside>', f'<div class="related"><p>{word()} {word()}.</p></div>'])
            head = r.choice(["", "", f"<h1>{say()}</h1>", f"<header><h1>{say()}</h1></header>"])
            body = f"<{tag}>{head}<p>{say()}</p>{box}{f'<p>{say()}</p>' if r.random() < 0.5 else ''}</{tag}>"
        elif kind < 0.85:
            body = "".join(block(r.choice(["p", "p", "p", "div", "blockquote", "pre", "h1", "h2", "section"])) for _ in range(r.choice([1, 1, 1, 2, 3])))
        else:
            body = ""
        if r.random() < 0.25 or not body:
            before, after = (r.choice(frames)() if r.random() < 0.6 else "" for _ in range(2))
            body = f"{before}{body}{after}" or r.choice(frames)()
        if r.random() < 0.15:
            body = f"<div>{body}</div>"
        if r.random() < 0.5:
            body = f"<html>{r.choice(['', '<head><title>t</title></head>'])}<body{r.choice(['', '', ' class="header-fixed"'])}>{body}</body></html>"
        out.append(body)
    return out


@functools.cache
def trained() -> TreeModel:
    """The model fitted to the labelled pages; the same in every process."""
    trees = [parse(page) for page in [*(page for page, _ in labelled_pages()), *plain_pages()]]
    forest = Forest(trees)
    labels = np.zeros(len(forest.kind), int)
    for tree, base in zip(trees, forest.base, strict=False):
        for node, text in tree.runs.items():
            if text.startswith("X"):
                labels[base + node] = 1
    # an element is content if a run below it is, up to the smallest element that holds all content runs and to a main element, or to the root of a page without one
    for tree, base in zip(trees, forest.base, strict=False):
        good = [x for x in tree.runs if labels[base + x]]
        paths = []
        for x in good:
            path = []
            while x > 0:
                x = tree.parent[x]
                path.append(x)
            paths.append(path)
        shared = set(paths[0]).intersection(*paths[1:]) if paths else set()
        deepest = max(shared, key=lambda x: tree.depth[x], default=-1)
        for path in paths:
            top = min((tree.depth[x] for x in path if tree.kind[x] == MAIN), default=len(path))
            for x in path:
                if MAIN not in tree.kind or tree.depth[x] >= min(tree.depth[deepest], top):
                    labels[base + x] = 1
    model = TreeModel()
    model.fit(forest, labels)
    return model


def extract(pages: list[str], model: TreeModel) -> Iterator[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    marginal = model.infer(forest)[0][:, 1] if trees else np.zeros(0)
    for tree, base in zip(trees, forest.base, strict=False):
        yield "\n\n".join(text for node, text in tree.runs.items() if marginal[base + node] >= 0.5)


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            group, size = [], 0
            for x in batch.column(2):
                group.append(x.as_py() or "")
                size += len(group[-1])
                if size > 1 << 20:
                    texts += extract(group, shared.value)
                    group, size = [], 0
            texts += extract(group, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
