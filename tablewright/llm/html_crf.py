"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (stretches of text between block-level tags). Every block has features of its ancestors
(tags, words of their class and id) and of its text; labels (main text or not) also depend on the block before. Weights
are trained by maximum likelihood on labelled pages and the best labelling of a page is found by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_labelled import labelled_pages
from .scratch import lowest

SLOTS = 1 << 13                    # hashed feature slots
SAMPLE_PAGES = 200                 # pages whose words fill the labelled layouts
LABELLED = 800                     # labelled pages trained on

# Element names with a fixed meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
NOTES = frozenset(("annotation", "annotation-xml"))          # a formula once more, in another notation; never shown
INLINE |= MATH | NOTES
UNSEEN = frozenset("script style template head title svg iframe noframes datalist".split())
CLOSES = {                         # an opening tag ends an open element of these kinds
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr"),
}
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())


def scopes(tag: str) -> frozenset:
    """Elements that an end of ``tag`` does not reach out of."""
    if tag in ("head", "body", "html"):
        return frozenset()
    if tag in TABLE_PARTS:
        return frozenset(("table", "html")) - {tag}
    return frozenset(("table", "td", "th", "html", "ul", "ol", "dl") if tag in ("li", "dt", "dd") else ("table", "td", "th", "html"))

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A comment, a tag with its attributes (quotes may hold ">"), a tag with an open quote, or a declaration.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style title textarea iframe noframes xmp".split())
_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW | NOTES}


def slot(feature: str) -> int:
    return crc32(feature.encode()) % SLOTS


_OWN: dict[tuple[str, str], frozenset] = {}
_SCOPES: dict[str, frozenset] = {}


def own_slots(tag: str, attributes: str) -> frozenset:
    """Slots of an element by itself: its tag and the words of its class, id and role."""
    key = (tag, attributes)
    got = _OWN.get(key)
    if got is None:
        names = {w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(unescape(m[1] or m[2] or m[3] or ""))} if attributes else ()
        got = frozenset([slot(f"in:{tag}"), *(slot(f"named:{w}") for w in names)])
        if len(_OWN) < 10_000:                          # a memory of common openings only; others are worked out again
            _OWN[key] = got
    return got


def leaf_blocks(html: str) -> list[tuple[str, frozenset, str, int]]:
    """``(text, ancestor slots, nearest block tag, characters in links)`` of every block with text, in page order.

    Inline elements and line breaks do not end a block. Unclosed and wrongly nested elements are closed as browsers do
    for the common cases; text of scripts, styles and other unseen elements is left out. Formulas are text of the
    sentence they stand in (without their source in another notation); what objects and canvases hold is text like any other.
    """
    blocks: list[tuple[str, frozenset, str, int]] = []
    stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]      # tag, slots of it and all above, unseen
    parts: list[str] = []
    extra: frozenset = frozenset()                      # slots of named inline elements of the block
    linked = at = 0
    in_link = False

    def flush() -> None:
        nonlocal parts, extra, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, stack[-1][1] | extra if extra else stack[-1][1], stack[-1][0], linked))
            parts = []
        extra, linked = frozenset(), 0

    def end(tag: str) -> None:
        within = _SCOPES.get(tag)
        if within is None:
            within = scopes(tag)
            if len(_SCOPES) < 1000:
                _SCOPES[tag] = within
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, attributes = name.lower(), (m[3] if m[2] else m[6])
        if m[1] or m[4]:                                # an end tag
            if tag == "a":
                in_link = False
            elif tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
                in_link = False
                if tag not in VOID:
                    end(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            if tag in NOTES and (close := _ENDS[tag].search(html, at)):
                at = close.start()
            if attributes:
                named = own_slots(tag, attributes)
                if len(named) > 1:
                    extra = extra | named
            continue
        flush()
        in_link = False
        if tag in ENDS_PARAGRAPH:
            end("p")
        for closed in CLOSES.get(tag, ()):
            end(closed)
        if tag == "body":
            end("head")
        if tag in VOID:
            continue
        if tag in RAW:
            close = _ENDS[tag].search(html, at)
            inner = html[at:close.start()] if close else html[at:]
            at = close.start() if close else size
            if tag not in UNSEEN:
                stack.append((tag, stack[-1][1] | own_slots(tag, attributes), stack[-1][2]))
                say(inner)
                flush()
                stack.pop()
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "g"):
            continue
        stack.append((tag, stack[-1][1] | own_slots(tag, attributes), stack[-1][2] or tag in UNSEEN))
    flush()
    return blocks


_STEPS = (20, 40, 80, 160, 320, 640)
_BINS = {f"{kind}{i}": slot(f"{kind}:{i}") for kind in ("long", "links", "at", "stops", "digits") for i in range(12)}
_FLAGS = {f: slot(f"text:{f}") for f in ("sentence", "capital", "sign", "every")}
_PARENT: dict[str, int] = {}


def features(blocks: list[tuple[str, frozenset, str, int]]) -> list[list[int]]:
    """Active slots of every block of a page."""
    rows = []
    for i, (text, above, tag, linked) in enumerate(blocks):
        n = len(text)
        parent = _PARENT.get(tag)
        if parent is None:
            parent = slot(f"parent:{tag}")
            if len(_PARENT) < 1000:
                _PARENT[tag] = parent
        row = [*above, parent, _FLAGS["every"], _BINS[f"long{sum(n > s for s in _STEPS)}"], _BINS[f"links{min(4, 4 * linked // n)}"],
               _BINS[f"at{0 if i == 0 else 2 if i == len(blocks) - 1 else 1}"], _BINS[f"stops{min(3, text.count('. ') + text.count(', '))}"]]
        if text[-1] in ".!?…。\"”":
            row.append(_FLAGS["sentence"])
        if text[0].isupper():
            row.append(_FLAGS["capital"])
        if "©" in text:
            row.append(_FLAGS["sign"])
        rows.append(row)
    return rows


class Model:
    """``weight[slot]`` is added to the main label's score; ``start`` and ``step`` score first labels and pairs."""

    def __init__(self, weight: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.weight, self.start, self.step = weight, start, step

    def label(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi); of equal ones the lower label."""
        if not rows:
            return []
        score = [float(self.weight[row].sum()) for row in rows]
        (a, b), ((aa, ab), (ba, bb)) = self.start.tolist(), self.step.tolist()
        no, yes, back = a, b + score[0], []
        for s in score[1:]:
            back.append((int(no + aa < yes + ba), int(no + ab < yes + bb)))
            no, yes = max(no + aa, yes + ba), max(no + ab, yes + bb) + s
        at = int(no < yes)
        labels = [at]
        for step in reversed(back):
            at = step[at]
            labels.append(at)
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Maximum likelihood by forward-backward and adaptive gradient steps, all pages at once (padded to one length)."""
    pages = [p for p in pages if p[0]]
    n, long, wide = len(pages), max(len(r) for r, _ in pages), max(len(x) for r, _ in pages for x in r)
    at = np.full((n, long, wide), SLOTS)
    gold = np.zeros((n, long), dtype=int)
    there = np.zeros((n, long), dtype=bool)
    for i, (rows, labels) in enumerate(pages):
        for t, row in enumerate(rows):
            at[i, t, :len(row)] = row
        gold[i, :len(rows)], there[i, :len(rows)] = labels, True
    theta = np.zeros(SLOTS + 7)                     # slots, the padding slot, start, step
    past = np.zeros_like(theta)
    for _ in range(rounds):
        weight = theta[:SLOTS + 1].copy()
        weight[SLOTS] = 0
        start, step = theta[SLOTS + 1:SLOTS + 3], theta[SLOTS + 3:].reshape(2, 2)
        score = weight[at].sum(2)
        own = np.stack([np.zeros_like(score), score], axis=2)
        forward, backward = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        forward[:, 0] = start + own[:, 0]
        for t in range(1, long):
            now = np.logaddexp(forward[:, t - 1, 0, None] + step[0], forward[:, t - 1, 1, None] + step[1]) + own[:, t]
            forward[:, t] = np.where(there[:, t, None], now, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            now = np.logaddexp(step[:, 0] + (own[:, t + 1, 0] + backward[:, t + 1, 0])[:, None], step[:, 1] + (own[:, t + 1, 1] + backward[:, t + 1, 1])[:, None])
            backward[:, t] = np.where(there[:, t + 1, None], now, 0)
        last = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        belief = np.exp(forward + backward - last[:, None, None])
        gap = np.where(there, gold - belief[:, :, 1], 0)
        slope = np.zeros_like(theta)
        slope[:SLOTS + 1] = np.bincount(at.ravel(), weights=np.repeat(gap.ravel(), wide), minlength=SLOTS + 1)
        slope[SLOTS] = 0
        slope[SLOTS + 1:SLOTS + 3] = [((gold[:, 0] == k) - belief[:, 0, k]).sum() for k in (0, 1)]
        pair = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                likely = np.exp(forward[:, :-1, a] + step[a, b] + own[:, 1:, b] + backward[:, 1:, b] - last[:, None])
                seen = (gold[:, :-1] == a) & (gold[:, 1:] == b)
                slope[SLOTS + 3 + 2 * a + b] = ((seen - likely) * pair).sum()
        slope = slope / n - decay * theta
        past += slope ** 2
        theta = theta + rate * slope / (np.sqrt(past) + 1e-8)
    return Model(theta[:SLOTS], theta[SLOTS + 1:SLOTS + 3], theta[SLOTS + 3:].reshape(2, 2))


def examples(pages: list[tuple[str, set[str]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of labelled pages ``(html, texts of the main blocks)``."""
    out = []
    for html, main in pages:
        blocks = leaf_blocks(html)
        out.append((features(blocks), [int(b[0] in main) for b in blocks]))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, labelled: int = LABELLED) -> Model:
    """A model trained on ``labelled`` pages whose layouts are known and whose words come from a sample of ``pages``.

    The sample (by digest of the row, at most ``sample`` pages) only lends its vocabulary.
    """
    digest = F.xxhash64("page_id", "html")
    known = pages.where("html is not null").select(F.col("html"), digest.alias("d"))
    picked = [r.d for r in lowest(known.select("d").distinct(), F.col("d"), pages.count(), sample).collect()]
    # repeated rows have one digest, so at most as many rows come back as were picked
    rows = known.where(F.col("d").isin(picked)).groupBy("d").agg(F.first("html").alias("html")).collect()
    words = sorted({w for r in rows for b in leaf_blocks(r.html) for w in b[0].split()})
    return train(examples(labelled_pages(words, labelled)))


def main_text(html: str, model: Model) -> str:
    blocks = leaf_blocks(html)
    return "\n\n".join(b[0] for b, keep in zip(blocks, model.label(features(blocks))) if keep)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null or empty html, and pages without main text, give an empty text. Ids and urls are passed on as they are, null
    too; repeated rows are extracted each; no rows give no rows; further columns are ignored.
    """
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", model) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
