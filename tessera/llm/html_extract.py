"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree.  Each has a hidden
label, content or not; node potentials come from its features (tag, class and
id words, text length, link share), edge potentials from the labels of parent
and child.  Messages go up the tree and down again (sum-product), which gives
each block's exact marginal.  Both potentials are counts over labelled pages."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed element classes of HTML.
RAW = frozenset("script style textarea title template noscript iframe noframes noembed svg object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var br img wbr math mi mo mn mrow mfrac msup msub msubsup msqrt mroot "
                   "mtext mspace mover munder munderover mtable mtr mtd mstyle mpadded semantics".split())
NEVER = frozenset("head button select option input datalist menu dialog nav".split())
#: Elements that say nothing about what they hold: a page of nothing else is all text.
BARE = frozenset("page html body".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hr main menu nav ol p pre section table ul".split())
#: An open element that a new one of the set closes, up to the nearest boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Whole words in class, id or role that name furniture, for pages without labels.
FURNITURE = re.compile(
    r"(?:top|side|sub|main|site|page|foot|bottom|head|global)?(?:nav|navs|navbar|navigation|menu|menus|menubar|header|footer)|"
    r"(?:mega|dropdown)menu|headers|masthead|footers|sidebars?|asides?|widgets?|widgetarea|cookies?|cookie(?:bar|banner|consent|notice)|"
    r"consent|notices?|banners?|popups?|modals?|ads?|ad(?:sense|slot|box|unit|banner|container|wrapper)|adsbygoogle|"
    r"adverts?|advertis(?:ements?|ing|er)|sponsor(?:s|ed)?|promos?|promot(?:ed|ions?)|breadcrumbs?|pagination|comments?|"
    r"comment(?:s?list|s?form|box|area|body|respond|section)|disqus|discuss|reply|replies|share|shares|sharing|share(?:bar|box|buttons?|links|this)|"
    r"social|social(?:bar|icons|links|media|share)|related|related(?:articles|content|links|posts)|recommended|newsletters?|"
    r"newsletter(?:form|signup)|subscribe|signup|login|loginform|search|search(?:bar|box|form)|copyright|legal|toolbars?|skip|skip(?:link|links|nav)|hidden")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Where the quotes of a tag never close.
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: One attribute after the other: whole name, optional value.
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OPEN = re.compile(r"<(?:/?[a-zA-Z]|[!?])[^>]*\Z")

#: Labelled pages that the potentials are counted on (a hash sample of about this many).
TRAIN_PAGES = 4_000


class Node:
    __slots__ = ("tag", "words", "parent", "text", "linked", "hidden", "furniture", "under")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None, hidden: bool):
        self.tag, self.words, self.parent, self.hidden = tag, words, parent, hidden
        self.text = self.linked = 0  # own characters, those inside links
        self.furniture = any(FURNITURE.fullmatch(w) for w in words)
        self.under = parent is not None and (parent.furniture or parent.under)


class _Open:
    """The open elements, and for each tag where it is open: all that an end
    or an implied end asks for is a look at the last places."""

    def __init__(self, root: Node):
        self.stack: list[list] = [["page", root, True]]  # tag, block element, open
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]  # places of those that are no inline elements

    def push(self, tag: str, node: Node | None = None) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append([tag, node or self.stack[-1][1], True])

    def last(self, *tags: str) -> int:
        """The deepest place where one of the tags is open; 0 if none is."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def drop_inline(self, tag: str) -> None:
        """Ends an inline element in the middle; its place stays, unused."""
        self.stack[self.where[tag].pop()][2] = False

    def pop(self) -> tuple[str, bool]:
        tag, _, was_open = self.stack.pop()
        if was_open:
            self.where[tag].pop()
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        return tag, was_open


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements in document order (the first is the page), and the
    text blocks: runs of text between block boundaries, with references
    decoded and white space folded.  Missing end tags are implied as in HTML.

    Takes time in proportion to the page, whatever is nested or never closed:
    what is known to be missing is not looked for again."""
    root = Node("page", (), None, False)
    nodes, blocks = [root], []
    tree = _Open(root)
    stack = tree.stack
    pending: list[str] = []
    links = at = 0

    def flush():
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                node = stack[-1][1]
                blocks.append((node, text))

    def add(raw: str):
        if raw:
            pending.append(raw)
            node = stack[-1][1]
            n = len(raw.strip())
            node.text += n
            node.linked += n if links else 0

    def pop_to(depth: int):
        nonlocal links
        while len(stack) > depth:
            if stack[-1][0] not in INLINE:
                flush()
            tag, was_open = tree.pop()
            if tag == "a" and was_open:
                links -= 1

    def close(tags, until) -> None:
        place = tree.last(*tags)
        if place > tree.last(*until):
            pop_to(place)

    missing: set[str] = set()

    def find(what: str, start: int, text: str = page) -> int:
        """Where the text goes on with ``what``; -1 at once if an earlier
        search came to the end of the page."""
        if what in missing:
            return -1
        end = text.find(what, start)
        if end < 0:
            missing.add(what)
        return end

    low, size, last = None, len(page), page.rfind(">")
    look = 0  # the next tag is looked for from here, text is taken from ``at``
    while at < size:
        lt = page.find("<", look)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):
            rest = page[at:]
            cut = _OPEN.search(rest) if lt >= 0 else None  # a tag that the page's end cuts off
            add(rest[:cut.start()] if cut else rest)
            break
        if page.startswith("<!--", lt):
            add(page[at:lt])
            end = find("-->", lt + 4)
            at = look = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", lt) and (end := find("]]>", lt + 9)) >= 0:
            add(page[at:lt])
            add(page[lt + 9:end])
            at = look = end + 3
            continue
        if page[lt + 1] in "!?":
            add(page[at:lt])
            at = look = page.find(">", lt) + 1
            continue
        m = None if "quotes" in missing else _TAG.match(page, lt)
        if m is None:
            m = _BROKEN_TAG.match(page, lt)
            if m is None:
                look = lt + 1
                continue
            missing.add("quotes")  # they are open to the page's end
        add(page[at:lt])
        at = look = m.end()
        tag = m.group(2).lower()
        if m.group(1):  # an end tag
            if tag in INLINE:
                if tree.last(tag) > tree.blocks[-1]:
                    tree.drop_inline(tag)
                    links -= tag == "a"
            elif tree.last(tag):
                pop_to(tree.last(tag))
            else:
                flush()
            continue
        if tag in RAW or tag == "xmp":
            low = page.lower() if low is None and len(page.lower()) == size else low
            if tag in ("svg", "object") and m.group(3).rstrip().endswith("/"):
                continue
            end = find("</" + tag, at, low or page)
            if tag in ("noscript", "svg", "object", "canvas", "template") and end < 0:
                continue
            after = page.find(">", end) if end >= 0 else -1
            if tag == "xmp":  # text as it stands
                flush()
                add(page[at:end if end >= 0 else size].replace("&", "&amp;"))
                flush()
            at = look = after + 1 if after >= 0 else size
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID and not (tag[0] == "m" and m.group(3).endswith("/")):
                if tag == "a" and tree.last("a"):
                    links -= 1
                    tree.drop_inline("a")
                tree.push(tag)
                links += tag == "a"
            continue
        flush()
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "button", "table"))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in VOID:
            continue
        words, hidden = [], stack[-1][1].hidden or tag in NEVER
        for a in _ATTR.finditer(m.group(3)):
            name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
            if name == "hidden" or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                words += _NAMES.findall(_CAMEL.sub(" ", value).lower())
        # inline elements that are still open are closed with the block before; misnested ones end here
        node = Node(tag, tuple(words), stack[-1][1], hidden)
        nodes.append(node)
        tree.push(tag, node)
    flush()
    _hide_forms(nodes)
    return nodes, blocks


def _hide_forms(nodes: list[Node]) -> None:
    """Forms are no main text, but for one around the page: a form with at
    least half of the text is taken for a mere wrapper."""
    if not any(n.tag == "form" for n in nodes):
        return
    place = {id(n): i for i, n in enumerate(nodes)}
    held = [0 if n.hidden else n.text for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        held[place[id(nodes[i].parent)]] += held[i]
    for n, text in zip(nodes, held):
        n.hidden = n.hidden or (n.parent is not None and n.parent.hidden) or (n.tag == "form" and 2 * text < held[0])


# --------------------------------------------------------------------- model

def _bucket(n: int) -> int:
    return min(8, n.bit_length() // 2) if n else -1


def node_features(node: Node) -> list[str]:
    out = ["tag=" + node.tag, f"len={_bucket(node.text)}"]
    if node.text:
        out.append(f"links={int(4 * min(1.0, node.linked / node.text))}")
    out += ["word=" + w for w in set(node.words)]
    if node.furniture:
        out.append("furniture")
    if node.under:
        out.append("under furniture")
    return out


def landmark_labels(nodes: list[Node]) -> dict[int, int | None] | None:
    """Labels of a page that marks its own main text: content is what lies in
    its one ``article`` or ``main`` element.  Nodes inside that only a name
    calls furniture, and what they hold, get no label (None): the name is a
    feature, so it must not be its own evidence.  Pages without such a mark
    label nothing."""
    for tag in ("article", "main"):
        roots = [n for n in nodes if n.tag == tag]
        if len(roots) == 1:
            break
    else:
        return None
    labels: dict[int, int | None] = {}
    for n in nodes:
        above = labels[id(n.parent)] if n.parent is not None else 0
        if n is roots[0]:
            labels[id(n)] = 1
        elif not above or n.hidden or n.tag in ("aside", "footer", "header"):
            labels[id(n)] = None if above is None else 0
        else:
            labels[id(n)] = None if n.furniture else 1
    return labels


def count_page(page: str | None, counts: Counter) -> None:
    """Adds the page's ``(parent's label | feature, label)`` counts."""
    nodes, _ = parse(page or "")
    labels = landmark_labels(nodes)
    if labels is None:
        return
    for n in nodes:
        y, above = labels[id(n)], labels[id(n.parent)] if n.parent is not None else 0
        if y is None or above is None:
            continue
        for f in ["all", *node_features(n)]:
            counts[f"{above}|{f}", y] += 1


#: Pseudo-counts (content, other) of what a corpus may not show.
PRIOR = {"furniture": (0.05, 200.0), "under furniture": (0.05, 200.0), "tag=aside": (0.05, 20.0),
         "tag=footer": (0.05, 20.0), "tag=header": (0.5, 5.0), "tag=p": (3.0, 1.0), "tag=article": (20.0, 0.05), "tag=main": (20.0, 0.05)}
#: The same for a child of content, and of other nodes.
EDGE_PRIOR = {1: (20.0, 1.0), 0: (1.0, 20.0)}


def potentials(counts: dict[tuple[str, int], int]) -> dict[str, float]:
    """Pairwise potentials as log-odds of content: of any child given its
    parent's label (``1|all``, ``0|all``), and what each feature adds to it.

    Inside content a feature counts as far as it was seen there: lists of a
    menu say nothing about lists of an article.  Outside content, a feature
    that was not seen there counts as over all nodes."""
    def logit(yes, no):
        return math.log(yes / no)

    def n(name, y):
        return counts.get((name, y), 0)
    features = {name.partition("|")[2] for name, _ in counts} | set(PRIOR)
    features.discard("all")
    pooled = logit(n("0|all", 1) + n("1|all", 1) + 1, n("0|all", 0) + n("1|all", 0) + 1)
    out = {}
    for above, (yes, no) in EDGE_PRIOR.items():
        base = out[f"{above}|all"] = logit(n(f"{above}|all", 1) + yes, n(f"{above}|all", 0) + no)
        for f in features:
            want = base
            if not above:
                want += logit(n("0|" + f, 1) + n("1|" + f, 1) + 0.5, n("0|" + f, 0) + n("1|" + f, 0) + 0.5) - pooled
            share = 1 / (1 + math.exp(-max(-12.0, min(12.0, want))))
            more = PRIOR.get(f, (0.0, 0.0))
            out[f"{above}|{f}"] = logit(n(f"{above}|{f}", 1) + share + more[0],
                                        n(f"{above}|{f}", 0) + 1 - share + more[1]) - base
    return out


def marginals(nodes: list[Node], model: dict[str, float]) -> list[float]:
    """P(content) of every node: messages up from the leaves, then down from
    the root, as log-odds.  ``nodes`` are in document order, so parents come
    first.  A node's factor over (own label, parent's label) has its label's
    log-odds ``edge[parent's label]`` plus its features', relative to the
    edge's own normaliser; the page's root has a parent that is no content."""
    def softplus(x: float) -> float:
        return max(x, 0.0) + math.log1p(math.exp(-abs(x)))

    place = {id(n): i for i, n in enumerate(nodes)}
    edge = [model["0|all"], model["1|all"]]
    factor = []
    for n in nodes:
        f = node_features(n)
        factor.append([edge[y] + max(-12.0, min(12.0, sum(model.get(f"{y}|{x}", 0.0) for x in f))) for y in (0, 1)])
    below, sent = [0.0] * len(nodes), [0.0] * len(nodes)  # children's messages, the message to the parent
    for i in range(len(nodes) - 1, 0, -1):
        up = [softplus(factor[i][y] + below[i]) - softplus(edge[y]) for y in (0, 1)]
        sent[i] = up[1] - up[0]
        below[place[id(nodes[i].parent)]] += sent[i]
    belief = [factor[0][0] + below[0]]
    for i in range(1, len(nodes)):
        parent = belief[place[id(nodes[i].parent)]] - sent[i]
        # sum over the parent's label: log-odds of this label
        yes = [factor[i][y] - softplus(edge[y]) for y in (0, 1)]
        no = [-softplus(edge[y]) for y in (0, 1)]
        one, two = parent + yes[1] - yes[0], parent + no[1] - no[0]
        belief.append(below[i] + yes[0] + softplus(one) - no[0] - softplus(two))
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]


def main_text(page: str | None, model: dict[str, float]) -> str:
    """The blocks whose element is content, in page order, one per line."""
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    if all(n.hidden or n.tag in BARE for n in nodes):  # no block says what is text and what is not
        return "\n".join(text for n, text in blocks if not n.hidden)
    p = {id(n): x for n, x in zip(nodes, marginals(nodes, model))}
    return "\n".join(text for n, text in blocks if not n.hidden and p[id(n)] >= 0.5)


# --------------------------------------------------------------------- Spark

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()),
                                           pa.array([k[1] for k in counts], pa.int32()),
                                           pa.array(counts.values(), pa.int64())], names=["name", "label", "n"])
    for batch in batches:
        for page in batch.column(0).to_pylist():
            count_page(page, counts)
            if len(counts) > 100_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bound: int = TRAIN_PAGES,
          min_count: int = 5) -> dict[str, float]:
    """The potentials from about ``bound`` pages, chosen by a hash of the id,
    that carry their own labels (``landmark_labels``).  Features in fewer than
    ``min_count`` nodes are left out, so the model's size follows the bound."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003)
    counted = (pages.filter(draw < (bound / n if n else 1.0)).select(html_col)
               .mapInArrow(_count, "name string, label int, n long").groupBy("name", "label").agg(F.sum("n").alias("n")))
    counts = {(r.name, r.label): r.n for r in counted.filter(F.col("n") >= min_count).collect()}
    return potentials(counts)


def main_text_column(model: dict[str, float], page: Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x, model) for x in pages.to_pylist()], pa.string())
    return extract(page)


def extract_pages(pages: DataFrame, model: dict[str, float], id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """The id, the url and ``text`` of every row; null or empty html and pages
    without content give the empty text; repeated rows come back each; very
    long, deeply nested and unclosed pages take time in proportion."""
    return pages.select(id_col, url_col, main_text_column(model, F.col(html_col)).alias("text"))
