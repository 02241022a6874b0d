"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its structural tags, told apart by the path of tags and classes above them, and the texts of its
blocks, told apart by path, too. A token's occurrence vector is how often it occurs in each page of its host. Tokens of
one host with equal vectors form an equivalence class; vectors are held as hashes over pages, so the vectors of hosts of
any size come from one partial aggregation. Classes that hold a tag, occur in at least ``SHARE`` percent of the host's
different pages and in at least ``LEAST`` of them, and whose tokens stand below tags of other such classes, nest into
the host's template.

The template's tags that stand once in a page bound its slots. Each has, over all the host's pages, its amount of text
and how much of that is links. The main slot is found from the root down: into the tag that holds at least ``MAIN``
percent of the unlinked text of the one above, until the text is spread over several, or the tag is an article. Slots
within the main slot that are mostly links over the host go, as do block texts of the template (boilerplate). Within
what is left the contract's exceptions go by kind (tag, role, class or id): adverts, forms, notices, reader comments.
Pages of hosts without such a template, or without its main slot, are read by these kinds alone.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, read, ship

#: Pages that a template must be seen in: fewer say nothing on what repeats.
LEAST = 5
SHARE = 80
MAIN = 60
#: A slot or list of so many percent links is a menu.
LINKED = 80
#: Template tokens that are broadcast at most; more are joined by a salted shuffle.
BROADCAST_TOKENS = 1_000_000
SALTS = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")

#: Elements that start and end a block; those that a new block closes; those that hold no content.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Containers of boilerplate: by tag, by role, and by a word of class or id.
DROP_TAGS = set("head nav footer aside form button select menu dialog input label fieldset".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion recommended recommendations related replies reply respond share sharing shares sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say nothing beside those: a class is of a boilerplate kind if it holds one of them and else only these.
PLAIN_WORDS = set(
    "area article articles bar block body bottom box button buttons center column container content entry form global group header inline inner item items large left link links list main mobile module node outer page panel post posts primary reader readers region right row secondary section side site slot small story text thread title top unit user view wrap wrapper zone".split()
)
HEAD_WORDS = {"header", "masthead", "topbar"}
MAIN_WORDS = {"articlebody"}


def _attrs(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)}


def _kinds(names: str) -> list[list[str]]:
    """The words of each class or id."""
    out = [[w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) if w] for x in names.split()]
    return [w for w in out if w]


def _boilerplate(kinds: list[list[str]], words: set[str] = DROP_WORDS) -> bool:
    return any(any(w in words for w in k) and all(w in words or w in PLAIN_WORDS or w.isdigit() for w in k) for k in kinds)


class Node:
    __slots__ = ("tag", "path", "up", "drop", "main", "article")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        a = _attrs(attrs) if attrs.strip() else {}
        kinds = _kinds(f"{a.get('class', '')} {a.get('id', '')}")
        self.tag, self.up = tag, up
        words = sorted({w for k in kinds for w in k})
        self.path = f"{up.path}/{tag}{'.' + '.'.join(words) if words else ''}" if up else ""
        inside = up.article if up else False
        outer = tag in ("html", "body", "article", "main")
        role = a.get("role", "").lower()
        self.drop = bool(
            (up and up.drop)
            or tag in DROP_TAGS
            or role in DROP_ROLES
            or "hidden" in a
            or a.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", a.get("style", ""), re.I)
            or ((tag == "header" or _boilerplate(kinds, HEAD_WORDS)) and not inside and tag not in ("html", "body"))
            or (not outer and _boilerplate(kinds))
            or (tag == "article" and _boilerplate(kinds, {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "promo", "related", "sponsored"}))
        )
        self.article = inside or (tag == "article" and not self.drop) or a.get("itemprop", "").lower() in MAIN_WORDS
        self.main = (up.main if up else False) or tag == "main" or role == "main"

    def above(self) -> list[Node]:
        """This element and those above it."""
        out, node = [], self
        while node:
            out.append(node)
            node = node.up
        return out


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: float):
        self.node, self.text, self.linked = node, text, linked


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Structural elements and text blocks of a page, in page order. Tag soup is read as browsers roughly do."""
    root = Node("", "", None)
    stack, nodes, blocks = [root], [], []
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html_lib.unescape(raw).split())
            if text:
                blocks.append(Block(stack[-1], text, linked / max(1, len(raw))))
            parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, close = tag.lower(), m[2] or m[5]
        if tag in BLOCKS:
            flush()
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                if tag in ("article", "section", "div", "body"):
                    links = 0
                continue
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()) or (stack[-1].tag == "head" and tag == "body")):
                stack.pop()
            node = Node(tag, m[4] or m[7] or "", stack[-1])
            nodes.append(node)
            if tag not in VOID:
                stack.append(node)
        elif tag == "a":
            links = 0 if close else 1
        elif tag == "br":
            parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
    flush()
    return nodes, blocks


def _hash(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def tokens_of(page: str) -> tuple[int, list[tuple]]:
    """A hash of the page's texts, and its tokens: (token, token of the tag above, whether a tag, whether an article, how
    often, code points of text below it, those in links)."""
    nodes, blocks = parse(page)
    out: dict[int, list] = {}
    names = {"": _hash("t", "")}
    for n in nodes:
        names[n.path] = t = names.get(n.path) or _hash("t", n.path)
        out.setdefault(t, [names[n.up.path], True, n.tag in ("article", "main") and not n.drop, 0, 0, 0])[3] += 1
    for b in blocks:
        out.setdefault(_hash("x", b.node.path, b.text), [names[b.node.path], False, False, 0, 0, 0])[3] += 1
        for n in b.node.above()[:-1]:
            one = out[names[n.path]]
            one[4] += len(b.text)
            one[5] += int(len(b.text) * b.linked)
    whole = _hash("p", "", "\n".join(b.text for b in blocks))
    return whole, [(k, *v) for k, v in out.items()]


def extract(page: str | None, template: dict[int, str] | None = None) -> tuple[str, bool]:
    """The main text of a page, and whether the template's main slot decided it; ``template``: what the tokens of its
    host's template are (main, drop, text). Null or empty pages have no text."""
    if not page:
        return "", False
    template = template or {}
    _, blocks = parse(page)
    seen: dict[str, tuple[bool, bool]] = {}

    def place(node: Node) -> tuple[bool, bool]:
        """Whether an element is in the main slot, and in one that goes."""
        if node.path not in seen:
            up = place(node.up) if node.up else (False, False)
            kind = template.get(_hash("t", node.path))
            seen[node.path] = (up[0] or kind == "main", up[1] or kind == "drop")
        return seen[node.path]

    kept = [b for b in blocks if not b.node.drop and template.get(_hash("x", b.node.path, b.text)) != "text"]
    slot = [b for b in kept if place(b.node) == (True, False)]
    if slot:
        return "\n".join(b.text for b in slot), True
    for frame in ("article", "main"):
        if any(getattr(b.node, frame) for b in kept):
            return "\n".join(b.text for b in kept if getattr(b.node, frame)), False
    return "\n".join(b.text for b in kept if b.linked * 100 < LINKED or b.node.tag not in ("li", "ul", "ol", "td", "dd", "div")), False


KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
NAMES = ["host", "page", "token", "up", "tag", "article", "n", "chars", "linked"]


def _tokens(batches):
    for b in batches:
        for k in range(0, b.num_rows, 512):
            c = b.slice(k, 512)
            rows: list[tuple] = []
            for host, page in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                whole, tokens = tokens_of(page)
                rows += [(host, whole, *t) for t in tokens]
            cols = list(zip(*rows)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], names=NAMES)


def nest(rows: list[dict]) -> dict[int, str]:
    """Of one host's frequent tokens (token, up, tag, article, vector, pages, most, chars, linked): what those of its
    template are. ``main``: the tag of the main slot; ``drop``: tags of slots within it that are menus; ``text``: texts of
    the template. The number of frequent tokens is bounded by the size of a page, whatever the number of pages."""
    classes: dict[tuple, list] = {}
    for r in rows:
        classes.setdefault((-r["pages"], r["vector"]), []).append(r)
    root = _hash("t", "")
    tags: dict[int, dict] = {root: {"token": root, "up": None, "most": 1}}
    open_ = [m for _, m in sorted(classes.items()) if any(r["tag"] for r in m)]
    texts = [r for m in classes.values() for r in m if not r["tag"]]
    while True:  # a class nests once the tags above its own are known to
        rest = []
        for members in open_:
            own = {r["token"]: r for r in members if r["tag"]}
            if all(r["up"] in tags or r["up"] in own for r in own.values()):
                tags |= own
            else:
                rest.append(members)
        if len(rest) == len(open_):
            break
        open_ = rest
    out = {r["token"]: "text" for r in texts if r["up"] in tags}
    below: dict[int, list[dict]] = {}
    for r in tags.values():
        if r["up"] is not None and r["most"] == 1:  # stands once in a page: a bound of slots
            below.setdefault(r["up"], []).append(r)
    plain = lambda r: r["chars"] - r["linked"]
    at, depth = None, 0
    level = below.get(root, [])
    while level:
        best = max(level, key=lambda r: (plain(r), -r["token"]))
        if at is not None and plain(best) * 100 < plain(at) * MAIN or not plain(best):
            break
        at, depth = best, depth + 1
        if at["article"]:
            break
        level = below.get(at["token"], [])
    if at is None or (depth < 3 and not at["article"]):  # the page or its body: nothing is told apart
        return out
    out[at["token"]] = "main"
    todo = list(below.get(at["token"], []))
    while todo:
        r = todo.pop()
        if r["chars"] and r["linked"] * 100 >= r["chars"] * LINKED:
            out[r["token"]] = "drop"
        else:
            todo += below.get(r["token"], [])
    return out


def _nest(table: pa.Table) -> pa.Table:
    host, out = table.column("host")[0].as_py(), nest(table.to_pylist())
    return pa.table({"host": pa.array([host] * len(out), pa.string()), "token": pa.array(list(out), pa.int64()), "kind": pa.array(list(out.values()), pa.string())})


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[^:/?#]*:?//([^/?#]*)", 1))


def templates(pages: DataFrame, ws: Workspace, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """Rows (host, token, kind): the template of each host (see ``nest``), from pages (host, html). Pages with equal texts count once."""
    ship(pages.sparkSession)
    schema = "host string, page long, token long, up long, tag boolean, article boolean, n long, chars long, linked long"
    seen = ws.put(pages.where("html is not null and host <> ''").select("host", "html").mapInArrow(_tokens, schema), "tokens")
    same = [F.any_value(c).alias(c) for c in ("up", "tag", "article")]
    one = seen.groupBy("host", "page", "token").agg(*[F.max(c).alias(c) for c in ("n", "chars", "linked")], *same)
    by = one.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), *same)
    all_ = seen.groupBy("host", "page").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("all"))
    often = by.where(F.col("pages") >= least).join(all_, "host").where(F.col("pages") * 100 >= F.col("all") * share).drop("all")
    out = ws.put(often.groupBy("host").applyInArrow(_nest, "host string, token long, kind string"), "template")
    ws.free("tokens")
    return out


def extract_pages(pages: DataFrame, ws: Workspace, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``pages`` (url, html, any others) with main_text, its blocks in page order, joined by newlines, and by_template,
    whether the main slot of its host's template decided them.

    Null or empty html gives an empty text; a null or odd url has no host and so no template, only the rules by kind.
    Pages are read whole; repeated pages count once for the template and are each returned; an empty table gives no
    rows; columns of the input named main_text or by_template are replaced, all others stay.
    """
    pages = pages.drop("main_text", "by_template")
    found = templates(pages.select(host_of().alias("host"), "html"), ws, least, share)
    n = found.count()
    lists = found.groupBy("host").agg(F.collect_list(F.struct("token", "kind")).alias("_tokens")).withColumnRenamed("host", "_host")
    df = pages.withColumn("_host", host_of())
    if n <= BROADCAST_TOKENS:
        df = df.join(F.broadcast(lists), "_host", "left")
    else:
        df = df.withColumn("_salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)))
        lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        df = df.join(lists, ["_host", "_salt"], "left")
    df = df.select(*[F.col(f"`{c}`") for c in pages.columns], "_tokens")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("html")
            given = b.column(b.num_columns - 1).to_pylist()
            texts = [extract(p, {x["token"]: x["kind"] for x in t or ()}) for p, t in zip(b.column(at).to_pylist(), given)]
            cols = [pa.array([x[0] for x in texts], pa.string()), pa.array([x[1] for x in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "main_text", "by_template"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return df.mapInArrow(run, f"{schema}, main_text string, by_template boolean")


def op10_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"), Workspace(spark, "op10"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "by_template")
