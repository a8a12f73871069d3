"""Main text of web pages: flat text blocks judged by a decision tree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import unused

# Element names by role, and words in class or id that name a part of a page.
BREAKING = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot
th thead title tr ul""".split())
HIDDEN = "script style noscript template svg math iframe object audio video canvas select textarea button title head".split()
# Without an end tag these hold the rest of the page; of the other hidden elements only the text up to the parent's end.
RAW = {"script", "style", "textarea", "title"}
VOID = set("area base br col embed img input link meta param source track wbr".split())
NESTING = set("""article aside blockquote body center details dialog div dl fieldset figure footer form header li main menu nav ol
section table tbody td tfoot th thead tr ul""".split())
APART = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset"}
STORY = {"article", "main"}
APART_WORDS = set("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie
cookies copyright discussion disqus donate footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice
alert pager pagination paywall popup promo recommended related replies reply respond share sharing sidebar signup skip social sponsor
sponsored subscribe subscription tags teaser toolbar topbar tracking widget""".split())
STORY_WORDS = set("article articlebody body content entry main post story text".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in HIDDEN}
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

FEATURES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "story", "apart", "heading", "item"]


def text_blocks(html: str | None) -> list[list]:
    """Flat blocks in page order: text and the values of ``FEATURES``.

    A block is the text between two block-level tags; character references are decoded and white
    space becomes single spaces. ``words`` counts words, ``links`` is the share of them inside
    links, also for the blocks before and after; ``story`` and ``apart`` tell whether an open
    element is an article's or a part beside it, by name or by its class, id or role.
    """
    found: list[list] = []
    piece: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    link, kind, at = 0, "", 0
    page = html or ""
    endless: set[str] = set()
    hushed: list[str] | None = None  # inside a hidden element without end: the elements opened in it

    def close() -> None:
        nonlocal piece
        text = " ".join("".join(t for t, _ in piece).split())
        if text:
            linked = sum(len(t.split()) for t, on in piece if on)
            n = len(text.split())
            found.append([text, n, min(1.0, linked / n), any(s for _, s, _ in stack), any(a for _, _, a in stack),
                          kind[:1] == "h" and kind[1:].isdigit(), kind in ("li", "dd", "dt", "td", "th")])
        piece = []

    while at < len(page):
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and hushed is None:
            piece.append((unescape(text), link > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        ends, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if not name:
            continue
        if name in ENDS and not ends and name != "head":
            if attributes.endswith("/"):
                continue
            end = ENDS[name].search(page, at) if name not in endless else None
            if end or name in RAW:
                at = end.end() if end else len(page)
            else:
                endless.add(name)
                hushed = hushed or []
            continue
        if name in BREAKING:
            hushed = None
        elif hushed is not None and ends:
            if name in hushed:
                del hushed[len(hushed) - 1 - hushed[::-1].index(name):]
            else:
                hushed = None
        elif hushed is not None and name not in VOID and not attributes.endswith("/"):
            hushed.append(name)
        if name == "a":
            link = 0 if ends else 1
        elif name == "br":
            piece.append((" ", False))
        if name not in BREAKING:
            continue
        close()
        kind = "" if ends else name
        link = 0
        if name not in NESTING:
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            words = {w.lower() for g in NAMED.findall(attributes) for w in WORDS.findall("".join(g))} if attributes else set()
            within = any(s for _, s, _ in stack)
            apart = name in APART or (name == "header" and not within) or bool(words & APART_WORDS)
            stack.append((name, name in STORY or (not apart and bool(words & STORY_WORDS) and name != "body"), apart and name != "body"))
    close()
    out = []
    for i, (text, n, links, story, apart, heading, item) in enumerate(found):
        before = found[i - 1] if i else [None, 0, 0.0]
        after = found[i + 1] if i + 1 < len(found) else [None, 0, 0.0]
        out.append([text, float(n), links, float(before[1]), before[2], float(after[1]), after[2],
                    float(story), float(apart), float(heading), float(item)])
    return out


def labelled_pages(pages: int = 400, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """A small labelled table of page layouts, made by rule: markup and, for each block, 1 if it is main text.

    Three styles: elements that say what they are, plain ``div`` with class names, and plain
    ``div`` without any name, where only words and links tell the parts apart.
    """
    rng = random.Random(seed)
    say = lambda a, b: " ".join("".join(rng.choice(("ka", "lo", "mi", "ren", "tu", "sol")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))
    for _ in range(pages):
        style, out, labels = rng.choice(("names", "classes", "plain")), [], []

        def part(name: str, cls: str, inner: list[str], *label: int) -> None:
            open_, end = {"names": (f"<{name}>", f"</{name}>"), "classes": (f'<div class="{cls}">', "</div>"), "plain": ("<div>", "</div>")}[style]
            out.append(open_ + "".join(inner) + end)
            labels.extend(label if len(label) > 1 else [*label] * len(inner))

        links = lambda n: [f'<li><a href="#">{say(1, 3)}</a></li>' for _ in range(n)]
        if rng.random() < 0.5:
            part("header", "masthead", [f"<p>{say(1, 5)}</p>"], 0)
        part("nav", "menu", links(rng.randint(3, 8)), 0)
        if rng.random() < 0.7:
            out.append(f'<div class="{rng.choice(("ad", "cookie-notice", "banner"))}">{say(3, 20)}</div>')
            labels.append(0)
        body = [f"<h1>{say(3, 10)}</h1>"] if style != "plain" or rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            words = say(18, rng.choice((60, 120, 400))) if style == "plain" or rng.random() < 0.6 else say(1, 17)
            body.append(rng.choice((f"<p>{words}</p>", f"<p>{words} <a href='#'>{say(1, 2)}</a> {say(4, 9)}</p>", f"<p>{words}</p>", f"<blockquote>{words}</blockquote>")))
        if style != "plain" and rng.random() < 0.4:
            body += [f"<li>{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))]
        if style != "plain" and rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), f"<h2>{say(2, 6)}</h2>")
        of_body = [1] * len(body)
        for _ in range(rng.choice((0, 0, 1, 2)) if style != "plain" else 0):
            at, inner = rng.randint(1, len(body)), f"<p>{say(2, rng.choice((30, 90)))}</p>"
            body.insert(at, rng.choice((f"<aside>{inner}</aside>", f'<div class="share-bar">{inner}</div>', f'<div class="comments">{inner}</div>',
                                        f"<nav>{inner}</nav>", f'<div class="ad-slot">{inner}</div>', f"<footer>{inner}</footer>", f"<form>{inner}</form>")))
            of_body.insert(at, 0)
        part("article", rng.choice(("post-content", "article-body", "entry")), body, *of_body)
        if rng.random() < 0.5:
            part("aside", "sidebar", links(rng.randint(2, 6)) + [f"<p>{say(2, 14)}</p>"], 0)
        if rng.random() < 0.5:
            out.append('<section class="comments">' + "".join(f"<p>{say(2, 90)}</p>" for _ in range(3)) + "</section>")
            labels.extend([0] * 3)
        if rng.random() < 0.3:
            out.append(f"<form><p>{say(2, 9)}</p><input></form>")
            labels.append(0)
        part("footer", "footer", [f"<p>&copy; {say(2, 14)}</p>"], 0)
        yield f"<html><body>{''.join(out)}</body></html>", labels


def fit_tree(spark: SparkSession, examples: list[tuple[str, list[int]]], depth: int = 8) -> DecisionTreeClassificationModel:
    """A decision tree on the blocks of labelled pages."""
    rows = [(*block[1:], float(label)) for html, labels in examples for block, label in zip(text_blocks(html), labels, strict=True)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*FEATURES, "label"])).coalesce(1)
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=3, seed=1).fit(table)


def tree_rule(model: DecisionTreeClassificationModel, block: Column) -> Column:
    """The tree as one condition on a block, so that it is applied inside the plan."""
    def rule(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        at = block[FEATURES[split.featureIndex()]]
        return F.when(at <= F.lit(float(split.threshold())), rule(node.leftChild())).otherwise(rule(node.rightChild()))

    return rule(model._java_obj.rootNode())


def main_text(pages: DataFrame, html_col: str = "html", model: DecisionTreeClassificationModel | None = None) -> DataFrame:
    """Puts ``text``, the page's main text, in place of the markup: the blocks that the tree accepts, one per line in page order.

    The whole markup is read, whatever its length; unclosed and crossed tags end where their
    parent ends, what a cut-off tag or script at the end holds is no text. Null and empty pages,
    and pages without a main block, have the empty text. ``n_blocks`` counts all blocks. Repeated
    rows give the same text; an empty table stays empty; columns of these names are replaced.
    """
    model = model or fit_tree(pages.sparkSession, list(labelled_pages()))
    kept = [c for c in pages.columns if c not in ("text", "n_blocks", html_col)]
    markup, found = unused("_html", kept), unused("_blocks", kept)
    light = pages.select(*kept, F.col(html_col).cast("string").alias(markup))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in FEATURES]]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([[tuple(b) for b in text_blocks(h.as_py())] for h in part.column(len(kept))], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], found])

    # A page's markup is several times its blocks; only the blocks come back.
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in light.schema.fields[:-1])
    block = "struct<text:string," + ",".join(f"{c}:double" for c in FEATURES) + ">"
    blocks = light.mapInArrow(cut, f"{fields}`{found}` array<{block}>")
    accepted = F.transform(F.filter(found, lambda b: tree_rule(model, b)), lambda b: b["text"])
    return blocks.select(*kept, F.array_join(accepted, "\n").alias("text"), F.size(found).cast("long").alias("n_blocks"))
