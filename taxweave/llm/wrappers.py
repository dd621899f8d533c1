"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of block tags and texts, balanced into a tree. In a wrapper a tree node has a
label (tag, classes and ids without digits, as those with digits are a page's own), children in order, and two marks: repeated (it
comes once or more) and optional.
- Siblings that repeat, alone or as a group of up to MAX_PERIOD, fold into one repeated node or group.
- Two wrappers align child by child, by the longest common subsequence of labels. What both have is aligned in
  turn, what one has alone becomes optional, and differing texts become slots. A slot remembers its most common text, by a
  majority count that merges; where that is the same on nearly all pages of the host it is the template's text.
Each task aligns the pages of a host it meets, then wrappers are aligned with each other, first within
GROUPS parts of a host and then over the host, so a host with most of the pages is no single task's work.

The finished wrapper names the element that holds the article, the parts of it that are none, and the template's texts in it (of
hosts of LEAST_PAGES pages or more; not where they are nearly all of the article, as on hosts of copies of one page). These rules, a few
strings a host, are what pages are joined with. A page is read
along its host's wrapper, or along its own if it has no such element; what stands outside the article, or in parts that
are none, is left out. Parts that are none are known by their tag or a whole class name, but what holds most of the
text outside links is kept whatever its name (comments are not), and so is what an article or main element stands in.

Elements below MOST_DEPTH are read in order as if they stood beside each other; inside a part that is none they are none too.

Null and empty pages give an empty text; a null or odd url counts as the host ''. Repeated pages are pages
each for itself. Pages of any length are read whole; of elements that are the article equally well (a tie) the outermost and first is taken. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.llm.common import pieces, settle

MAX_PERIOD = 4
GROUPS = 64
MOST_DEPTH = 60  # elements nested deeper stand in the tree beside each other

# Fixed word lists.
BLOCKS = set(
    "html head body div section article main aside nav header footer form fieldset table thead tbody tfoot tr td th caption ul ol li dl dt dd"
    " p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog hr title menu search hgroup center".split()
)
RAW = set("script style noscript template textarea iframe object svg math select button canvas audio video".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "head", "body", "title"}
NEVER = set("head title nav header footer aside form menu dialog search fieldset".split())
HINTS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navigation navbar breadcrumb breadcrumbs"
    " footer header comment comments reply replies respond discussion notice notices cookie cookies consent popup modal overlay newsletter subscribe"
    " share sharing social related recommended widget login signup toolbar pagination pager".split()
)
DISCUSSION = set("comment comments reply replies respond discussion".split())
ARTICLE = set("article main".split())
ARTICLE_HINTS = set("article content main post entry story maintext articlebody postbody entrycontent articlecontent postcontent maincontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_DIGIT = re.compile(r"\d")
#: A host's text is the template's if it is on nearly all of so many pages.
LEAST_PAGES, NEARLY_ALL = 8, 0.8
#: Rules of so many characters are sent to the tasks; more are joined by host.
RULES_SENT = 32 << 20
HOSTS_KEPT = 10_000


def _mark(text: str) -> str:
    """What stands for a line of text in a wrapper."""
    return hashlib.blake2b(" ".join(text.split()).encode(), digest_size=8).hexdigest()


def _stream(page: str):
    """(kind, value, link) of block tags and texts; kind is 'open', 'close' or 'text'."""
    at, links = 0, 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            yield "text", entities.unescape(text), links > 0
        if not found:
            return
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        closing, rest = found[1] or found[4], found[3] or found[6] or ""
        if not name:
            continue
        if name in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            yield "text", " ", False
        elif name in BLOCKS:
            if closing:
                yield "close", name, False
            else:
                names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if rest else ""
                yield "open", name + "".join("." + n for n in sorted(set(names.lower().split())) if not _DIGIT.search(n)), False
                if name in VOID:
                    yield "close", name, False


def tree(page: str) -> dict:
    """The page's blocks: label, children, and for '#' the text and how much of it is in links."""
    root = {"t": "", "c": []}
    stack = [("", root)]  # tags and nodes of the open elements

    for kind, value, link in _stream(page):
        tag, here = stack[-1]
        if kind == "text":
            holder = stack[min(len(stack), MOST_DEPTH) - 1][1]
            if len(stack) > MOST_DEPTH and holder["c"][-1] is not here and not value.isspace():  # a deep element goes on behind another one
                here = {"t": here["t"], "c": []}
                holder["c"].append(here)
                stack[-1] = (tag, here)
            last = here["c"][-1] if here["c"] else None
            if last is None or last["t"] != "#":
                if value.isspace():
                    continue
                last = {"t": "#", "c": [], "text": [], "link": 0}
                here["c"].append(last)
            last["text"].append(value)
            last["link"] += len(value) if link else 0
        elif kind == "open":
            name = value.partition(".")[0]
            if name in ENDS_PARAGRAPH and tag == "p" or name == "li" and tag == "li":
                stack.pop()
            if len(stack) > MOST_DEPTH and _is_none(stack[-1][1]["t"]):
                value = stack[-1][1]["t"]
            node = {"t": value, "c": []}
            stack[min(len(stack), MOST_DEPTH) - 1][1]["c"].append(node)
            stack.append((name, node))
        else:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == value:
                    del stack[depth:]
                    break
                if stack[depth][0] in ("article", "main", "body") and value in ("p", "li"):
                    break
    return root


def wrap(node: dict) -> dict:
    """A page's tree as a wrapper: texts become slots with their sizes, repeats are folded."""
    if node["t"] == "#":
        chars = sum(map(len, node["text"]))
        return {"t": "#", "c": [], "rep": False, "opt": False, "chars": chars, "link": node["link"], "top": _mark("".join(node["text"])), "lead": 1}
    return {"t": node["t"], "c": fold([wrap(c) for c in node["c"]]), "rep": False, "opt": False, "chars": 0, "link": 0}


def fold(children: list[dict]) -> list[dict]:
    """Neighbours that repeat become one repeated node, or a repeated group '()' of several."""
    for period in range(1, MAX_PERIOD + 1):
        out: list[dict] = []
        at = 0
        while at < len(children):
            unit = children[at : at + period]
            labels = [c["t"] for c in unit]
            times = 1
            while len(unit) == period and [c["t"] for c in children[at + times * period : at + (times + 1) * period]] == labels:
                unit = [align(a, b) for a, b in zip(unit, children[at + times * period : at + (times + 1) * period])]
                times += 1
            if times == 1 or labels == ["#"]:
                out.append(children[at])
                at += 1
            else:
                out.append(unit[0] | {"rep": True} if period == 1 else {"t": "()", "c": unit, "rep": True, "opt": False, "chars": 0, "link": 0})
                at += times * period
        children = out
    return children


def align(a: dict, b: dict) -> dict:
    """The wrapper of what both describe; their labels are equal. At the root pages are counted."""
    marks = {"rep": a["rep"] or b["rep"], "opt": a["opt"] or b["opt"], "chars": a["chars"] + b["chars"], "link": a["link"] + b["link"]}
    if "pages" in a and "pages" in b:
        marks["pages"] = a["pages"] + b["pages"]
    if a["t"] == "#":
        marks["top"] = a["top"] if a["lead"] >= b["lead"] else b["top"]
        marks["lead"] = a["lead"] + b["lead"] if a["top"] == b["top"] else abs(a["lead"] - b["lead"])
    return {"t": a["t"], "c": align_children(a["c"], b["c"])} | marks


def align_children(a: list[dict], b: list[dict]) -> list[dict]:
    if [x["t"] for x in a] == [y["t"] for y in b]:
        return [align(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["t"] == b[j]["t"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i]["t"] == b[j]["t"]:
            out.append(align(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"opt": True})
            i += 1
        else:
            out.append(b[j] | {"opt": True})
            j += 1
    return fold(out + [x | {"opt": True} for x in a[i:] + b[j:]])


def expression(node: dict) -> str:
    """The wrapper as a regular expression over tags, for people."""
    inner = "".join(map(expression, node["c"]))
    text = "#" if node["t"] == "#" else f"({inner})" if node["t"] == "()" else f"<{node['t']}>{inner}</>" if node["t"] else inner
    mark = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}[node["rep"], node["opt"]]
    return f"({text}){mark}" if mark and node["t"] != "()" else text + mark


def _hints(label: str) -> set[str]:
    """Words of HINTS that are a whole class name, or all parts of one."""
    tag, *names = label.split(".")
    if tag in ("html", "body", "main"):
        return set()
    parts = [set(re.split(r"[-_]", name)) for name in names]
    return {word for some in parts if some <= HINTS for word in some}


def _is_none(label: str) -> bool:
    """Whether an element of this label is no part of an article, by its name."""
    return label.partition(".")[0] in NEVER or bool(_hints(label))


def _rank(label: str) -> int:
    tag, *names = label.split(".")
    return 2 if tag == "article" else 1 if tag == "main" or any(re.sub(r"[-_]", "", n) in ARTICLE_HINTS for n in names) else 0


def _weigh(node: dict) -> int:
    """Sets "raw", the text outside links whatever holds it."""
    if node["t"] == "#":
        node["raw"] = max(0, node["chars"] - 2 * node["link"])
    else:
        inner = sum(map(_weigh, node["c"]))
        node["raw"] = 0 if node["t"].partition(".")[0] in ("head", "title") else inner
    return node["raw"]


def _dropped(node: dict, whole: int) -> bool:
    """Whether an element is left out of a page with so much text."""
    label = node["t"]
    return _is_none(label) and (2 * node["raw"] <= whole or bool(_hints(label) & DISCUSSION))


def _size(node: dict, whole: int) -> int:
    """Text outside links that could be the article's."""
    if node["t"] == "#":
        return node["raw"]
    return 0 if _dropped(node, whole) else sum(_size(c, whole) for c in node["c"])


#: Path of the article, paths of elements that are kept, and (path, mark) of the template's texts.
Rule = tuple[tuple[str, ...], frozenset[tuple[str, ...]], frozenset[tuple[tuple[str, ...], str]]]


def article_rule(wrapper: dict) -> Rule:
    """Labels from the root to the element that holds the article, the paths of elements that are kept whatever their
    names, and the template's texts in the article."""
    path, kept = _article(wrapper)
    return path, kept, _template(wrapper, path, kept)


def _template(wrapper: dict, path: tuple[str, ...], kept: frozenset) -> frozenset:
    """(path, mark) of texts in the article that nearly all pages of the host have."""
    pages, found, chars, whole = wrapper.get("pages", 1), set(), 0, 0

    def look(node, at):
        nonlocal chars, whole
        for child in node["c"]:
            if child["t"] == "#":
                if at[: len(path)] == path:
                    whole += child["chars"]
                    if child["lead"] >= NEARLY_ALL * pages:
                        found.add((at, child["top"]))
                        chars += child["chars"]
            elif child["t"] == "()":
                look(child, at)
            elif len(at) < len(path) or not _is_none(child["t"]) or (*at, child["t"]) in kept:
                look(child, (*at, child["t"]))

    if pages >= LEAST_PAGES:
        look(wrapper, ())
    return frozenset(found) if chars <= NEARLY_ALL * whole else frozenset()


def _article(wrapper: dict) -> tuple[tuple[str, ...], frozenset[tuple[str, ...]]]:
    whole = _weigh(wrapper)
    named: list[tuple[int, int, tuple[str, ...]]] = []
    hidden: list[tuple[int, int, tuple[str, ...]]] = []  # article and main elements in what is dropped by its class
    kept: set[tuple[str, ...]] = set()

    def look(node, path, inside):
        label = node["t"]
        if _dropped(node, whole):
            if label.partition(".")[0] in NEVER or _hints(label) & DISCUSSION:
                return
            inside = True
        elif _is_none(label):
            kept.add(path)
        rank = _rank(label)
        if rank and not (inside and (label.partition(".")[0] not in ARTICLE or _is_none(label))) and (size := _size(node, whole)):
            (hidden if inside else named).append((rank, size, path))
        for child in node["c"]:
            look(child, path if child["t"] == "()" else (*path, child["t"]), inside)

    look(wrapper, (), False)
    best = lambda some: max(some, key=lambda x: (x[0], x[1], [-len(x[2])]))
    found = best(named) if named else None
    if hidden and best(hidden)[1] > (found[1] if found else _size(wrapper, whole)):
        found = best(hidden)
    if found:
        return found[2], frozenset(kept)
    node, path = wrapper, ()
    while node["c"]:  # down to the element that holds nearly all of the text
        child = max(node["c"], key=lambda c: _size(c, whole))
        if child["t"] == "#" or _size(child, whole) < 0.8 * max(1, _size(node, whole)) or child["rep"]:
            break
        node, path = child, (*path, child["t"])
    return path, frozenset(kept)


def extract(page: str, rule: Rule) -> str:
    """The page's text along the rule of its host, a line for each block."""
    root = tree(page)
    lines = _read(root, rule)
    if not lines and rule[0]:  # the page has no such element: it is read by its own wrapper
        lines = _read(root, article_rule(wrap(root)))
    return "\n".join(lines)


def _read(root: dict, rule: Rule) -> list[str]:
    path, kept, template = rule
    lines: list[str] = []

    def read(node, at):
        for child in node["c"]:
            if child["t"] == "#":
                line = " ".join("".join(child["text"]).split())
                if line and not (template and (at, _mark(line)) in template):
                    lines.append(line)
            elif not _is_none(child["t"]) or (*at, child["t"]) in kept:
                read(child, (*at, child["t"]))

    def descend(node, depth):
        if depth == len(path):
            read(node, path)
            return
        for child in node["c"]:
            if child["t"] == path[depth]:
                descend(child, depth + 1)

    descend(root, 0)
    return lines


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON): one row for each host."""

    def by_task(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        known: dict[str, dict] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                new = wrap(tree(page.as_py() or "")) | {"pages": 1}
                known[host] = align(known[host], new) if host in known else new
        hosts, trees = list(known), [json.dumps(w) for w in known.values()]
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array([task % GROUPS] * len(hosts), pa.int32()), pa.array(trees, pa.string())], ["host", "part", "wrapper"])

    def together(key, table):
        wrapper = None
        for text in sorted(table.column("wrapper").to_pylist()):
            wrapper = align(wrapper, json.loads(text)) if wrapper else json.loads(text)
        return pa.table([[key[0].as_py()], pa.array([key[-1].as_py() if len(key) > 1 else 0], pa.int32()), [json.dumps(wrapper)]], ["host", "part", "wrapper"])

    kind = "host string, part int, wrapper string"
    parts = pages.select(_host().alias("host"), "html").mapInArrow(by_task, kind)
    parts = parts.groupBy("host", "part").applyInArrow(together, kind)
    return parts.groupBy("host").applyInArrow(together, kind).select("host", "wrapper")


def rules(wrappers: DataFrame) -> DataFrame:
    """host, rule (as JSON): what a page of the host is read by."""

    def made(batches):
        for batch in batches:
            out = []
            for text in batch.column("wrapper"):
                path, kept, template = article_rule(json.loads(text.as_py()))
                out.append(json.dumps([path, sorted(kept), sorted(template)]))
            yield pa.record_batch([batch.column("host"), pa.array(out, pa.string())], ["host", "rule"])

    return wrappers.mapInArrow(made, "host string, rule string")


def _rule(text: str | None) -> Rule:
    if text is None:
        return (), frozenset(), frozenset()
    path, kept, template = json.loads(text)
    return tuple(path), frozenset(map(tuple, kept)), frozenset((tuple(at), mark) for at, mark in template)


def main_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def texts(batches):
        known: dict[str, Rule] = {}
        for batch in batches:
            for some in pieces(batch, "html"):
                out = []
                for page, host, rule in zip(some.column("html"), some.column("host").to_pylist(), some.column("rule")):
                    if host not in known:
                        if len(known) > HOSTS_KEPT:
                            known.clear()
                        known[host] = _rule(rule.as_py())
                    out.append(extract(page.as_py() or "", known[host]))
                yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    of_hosts = settle(rules(wrappers), "rules")
    small = (of_hosts.agg(F.sum(F.length("host") + F.length("rule"))).first()[0] or 0) <= RULES_SENT
    return rows.join(F.broadcast(of_hosts) if small else of_hosts, "host", "left").mapInArrow(texts, "page_id long, url string, text string")
