"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its tags (name with class and id) and, outside articles, its text blocks, each told apart by the
open elements around it.  A token's occurrence vector says how often each page of the host has it.  Tokens with equal
vectors form an equivalence class; classes that occur in at least SUPPORT of the host's pages (and three of them) are
candidates.  Vectors are never materialised: each page draws a random 64-bit number and a token's vector is represented
by the sum of count * number modulo 2**64, so classes come from one grouped sum, however many pages a host has.

A class of two or more tokens is ordered on a page if the page repeats them in one order, and nested if whatever
opens between two of its tokens also closes there.  It belongs to the template in the order that SUPPORT of its pages
agree on.  The template is read off a page with a stack: a slot is the place between two consecutive tokens of a class,
inside the slots of the classes around it, and every text block lies in one.

Elements that say what they are (article, main; nav, footer, class "ad", ...) are evidence on the slots: the characters
of a slot on all pages that fit are counted as article, boilerplate or unmarked.  A slot that is chiefly article is
text, on pages without an article of their own with all it holds but a block's own boilerplate; one that is chiefly
boilerplate is dropped with all it holds.  In the others a page's own marks decide: its article blocks, and if the page has no article text at all, the unmarked
blocks that are not fixed text of the template, those of slots that hold articles on other pages before all others.  A page
does not fit if it has the template's tokens in another order or nesting, or not those of every page; such a page, or one
whose host has too few, is read by its own elements alone.

Inside an article only what is named as menu, footer, sidebar, notice, advert, form or comment is boilerplate; captions, headings
and sections of other classes are text.

Every page is parsed twice: once for its tokens, which are written as a table that the passes in between read, and once for its
text.  What is known of the hosts is sent to the executors if it has BROADCAST_TOKENS tokens or less.  Beyond that pages are
dealt out by host, those of hosts with more than HOST_PAGES pages (and more than one in HOT_HOSTS of all) by host and a number too, and
what is known of a host goes ahead of its pages, once for each task.

Defined results: null or empty html gives an empty text; a null or unusual url counts as a host of its own kind (''); equal
pages are extracted alike; unclosed elements end where HTML closes them; repeated rows give repeated rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import cut, drop, heavy_map, table

SUPPORT, LEAST_PAGES = 0.5, 3
#: Pages of a host that are dealt out together, and hosts that are divided at most (their names are broadcast).
HOST_PAGES, HOT_HOSTS = 2000, 50_000
#: Tokens of templates that are sent to every executor at most.
BROADCAST_TOKENS = 1_000_000
FLUSH = 200_000

# HTML's elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form menu header head dialog button label".split())
CONTENT = frozenset(("article", "main"))
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
# Words of classes and ids.  The first are boilerplate inside articles too, the second only outside.
_NAMED_PARTS = (
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login"
    r"|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|comments?|comment-\w+|disqus|respond|replies"
)
_OTHER_PARTS = r"alert|overlay|side|widget\w*|header|masthead|toolbar|share\w*|social|related|recommended|trending|pagination|pager|skip\w*|copyright|legal|disclaimer"
BOILERPLATE = re.compile(rf"(?:^|[\s_-])(?:{_NAMED_PARTS}|{_OTHER_PARTS})(?:$|[\s_-])", re.I)
IN_ARTICLES = re.compile(rf"(?:^|[\s_-])(?:{_NAMED_PARTS})(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


@functools.lru_cache(1 << 16)
def deeper(path: int, tag: str) -> int:
    """The hash of a tag inside a path."""
    return xxhash.xxh3_64_intdigest(f"{path}{tag}")


@functools.lru_cache(1 << 16)
def boilerplate(marks: str, in_article: bool) -> bool:
    return bool((IN_ARTICLES if in_article else BOILERPLATE).search(marks))


class Parser:
    """Reads a page.

    tokens: hashes in order, even for a tag, odd for a text block, 0 for a text block in content; kinds and texts of the
    blocks: CONTENT_BLOCK, DROPPED_BLOCK.
    """

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.has_content = False
        self._stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # name, in content, dropped, path
        self._text: list[str] = []
        self._read(source)

    def _tag(self, path: int):
        self.tokens.append(path >> 2 << 1)

    def _flush(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                _, content, dropped, path = self._stack[-1]
                self.tokens.append(0 if content else xxhash.xxh3_64_intdigest(f"{path}T:{text}") >> 2 << 1 | 1)
                self.kinds.append(CONTENT_BLOCK * content | DROPPED_BLOCK * dropped)
                self.texts.append(text)

    def _open(self, name: str, attributes: str):
        if name in CLOSES_P and any(n == "p" for n, *_ in self._stack):
            self._close("p", silent=True)
        if name in ("li", "dt", "dd", "tr", "td", "th") and self._stack[-1][0] == name:
            self._close(name, silent=True)
        if name in BLOCK:
            self._flush()
        named = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)} if attributes else {}
        marks = " ".join(named.values())
        _, content, dropped, path = self._stack[-1]
        path = deeper(path, f"<{name} {marks}".rstrip() + ">")
        self._tag(path)
        if name in VOID:
            if name in ("br", "hr"):
                self._text.append(" ")
            return
        dropped = dropped or name in DROPPED and not (name == "header" and content) or bool(marks) and name not in ("html", "body", "article", "main") and boilerplate(marks, content)
        if name in CONTENT and not dropped:
            content = self.has_content = True
        self._stack.append((name, content, dropped, path))

    def _close(self, name: str, silent: bool = False):
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth][0] == name:
                if name in BLOCK or any(n in BLOCK for n, *_ in self._stack[depth:]):
                    self._flush()
                if not silent:
                    self._tag(deeper(self._stack[depth][3], f"</{name}>"))
                del self._stack[depth:]
                break

    def _read(self, source: str):
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text.append(entities.unescape(source[at:]))
                break
            if m.start() > at:
                self._text.append(entities.unescape(source[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            elif name in RAW and not m[3].rstrip().endswith("/"):
                self._tag(deeper(self._stack[-1][3], f"<{name}>"))
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(name, m[3])
        self._flush()


CONTENT_BLOCK, DROPPED_BLOCK = 1, 2


class Page:
    """A parsed page: its tokens, and the kinds and texts (or their lengths) of its blocks."""

    def __init__(self, events: list[int], kinds: list[int], texts: list, has_content: bool):
        self.events, self.kinds, self.texts, self.has_content = events, kinds, texts, has_content

    @classmethod
    def of(cls, source: str) -> Page:
        p = Parser(source)
        return cls(p.tokens, p.kinds, p.texts, p.has_content)

    def tokens(self) -> list[int]:
        """Hashes of the template tokens, in order: tags (even), and text blocks outside content (odd)."""
        return [t for t in self.events if t]

    def orders(self, classes: dict[int, list[int]]) -> dict[int, list[int] | None]:
        """The order of each class that occurs on the page; None where it is not ordered or not nested here."""
        of = {t: c for c, members in classes.items() for t in members}
        found: dict[int, list[int]] = {}
        for t in self.tokens():
            if t in of:
                found.setdefault(of[t], []).append(t)
        out: dict[int, list[int] | None] = {}
        for c, seen in found.items():
            size = len(classes[c])
            order = seen[:size]
            out[c] = order if len(set(order)) == size and seen == order * (len(seen) // size) else None
        _, _, broken = self.slots(Template([(c, order, False) for c, order in out.items() if order]))
        return {c: None if c in broken else order for c, order in out.items()}

    def slots(self, template: Template) -> tuple[list[tuple[tuple[int, ...], bool]], dict[int, int], set[int]]:
        """(slots from the outermost, fixed text) of each block; how often each class is complete; the classes out of order or nesting."""
        stack: list[list[int]] = []
        done: dict[int, int] = {}
        broken: set[int] = set()
        found = []
        for t in self.events:
            at = template.place.get(t)
            if at is not None:
                c, i, size = at
                if i == 0:
                    stack.append([c, 0, 0])
                else:
                    inside = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == c), None)
                    if inside is None or stack[inside][1] != i - 1:
                        broken.add(c)
                        inside = None
                    else:
                        broken.update(other for other, *_ in stack[inside + 1 :])
                        del stack[inside + 1 :]
                        stack[-1][1] = i
                if i == 0 or inside is not None:
                    if i == size - 1:
                        stack.pop()
                        done[c] = done.get(c, 0) + 1
                    else:
                        stack[-1][2] = xxhash.xxh3_64_intdigest(f"{stack[-2][2] if len(stack) > 1 else 0}:{c}:{i}") >> 1
            if not t or t & 1:
                found.append((tuple(slot for *_, slot in stack), t in template.fixed))
        broken.update(c for c, *_ in stack)
        return found, done, broken

    def read(self, template: Template) -> list[tuple[tuple[int, ...], bool]] | None:
        """(slots from the outermost, fixed text) of each block, or None if the page does not fit the template."""
        found, done, broken = self.slots(template)
        return None if broken or any(done.get(c) != 1 for c in template.skeleton) else found

    def text(self, template: Template | None = None, roles: dict[int, str] | None = None) -> str:
        """roles: slot -> "text", "dropped" or "holds" (articles, on other pages); the page's own marks decide in other slots."""
        found = self.read(template) if template else None
        if found is None:
            return "\n".join(t for t, kind in zip(self.texts, self.kinds, strict=True) if not kind & DROPPED_BLOCK and (kind or not self.has_content))
        article, near, loose = [], [], []
        for t, kind, (slots, fixed) in zip(self.texts, self.kinds, found, strict=True):
            role = roles.get(slots[-1] if slots else 0)
            if kind & DROPPED_BLOCK or fixed or role == "dropped":
                continue
            if kind or role == "text" and not self.has_content:
                article.append(t)
            else:
                loose.append(t)
                if role == "holds":
                    near.append(t)
        return "\n".join(article or near or loose)


class Template:
    """The ordered, nested classes of a host.

    place: token -> (class, position in its order, tokens of the class); skeleton: classes that every page has once;
    fixed: text tokens.
    """

    def __init__(self, classes: list[tuple[int, list[int], bool]], fixed=()):
        self.place = {t: (c, i, len(order)) for c, order, _ in classes for i, t in enumerate(order)}
        self.skeleton = [c for c, _, once in classes if once]
        self.fixed = frozenset(fixed)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, tokens, kinds and sizes (of the blocks) of rows (page_id, url, host, html)."""

    def run(batches):
        for batch in batches:
            pages = [Parser(source.as_py()) for source in batch.column(3)]
            sizes = [[len(t) for t in p.texts] for p in pages]
            lists = [pa.array([p.tokens for p in pages], pa.list_(pa.int64())), pa.array([p.kinds for p in pages], pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *lists], ["page_id", "url", "host", "tokens", "kinds", "sizes"])

    return heavy_map(pages, run, "page_id bigint, url string, host string, tokens array<bigint>, kinds array<int>, sizes array<int>")


def occurrence_sums(pages: DataFrame) -> DataFrame:
    """(host, token, n_pages, total, vector) of rows (page_id, host, tokens); token 0 stands for the page itself."""

    def run(batches):
        have: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for page, host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                draw = xxhash.xxh3_64_intdigest(f"{page}:{host}")
                counts = collections.Counter(tokens)
                counts[0] = 1
                for t, n in counts.items():
                    x = have.get((host, t))
                    if x is None:
                        have[host, t] = [1, n, n * draw % (1 << 64)]
                    else:
                        x[0] += 1
                        x[1] += n
                        x[2] = (x[2] + n * draw) % (1 << 64)
                if len(have) >= FLUSH:
                    yield flush(have)
                    have = {}
        if have:
            yield flush(have)

    def flush(have):
        hosts, tokens = zip(*have, strict=True)
        a, b, c = zip(*have.values(), strict=True)
        c = [x - (1 << 64) if x >> 63 else x for x in c]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (tokens, a, b, c))], ["host", "token", "n_pages", "total", "vector"])

    part = heavy_map(pages, run, "host string, token bigint, n_pages bigint, total bigint, vector bigint")
    return part.groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), F.sum("total").alias("total"), F.expr("try_cast(pmod(sum(cast(vector as decimal(38,0))), 18446744073709551616BD) as decimal(20,0))").alias("vector"))


def candidates(sums: DataFrame) -> DataFrame:
    """host, classes (class, members, once): the equivalence classes of each host with enough pages."""
    sizes = sums.where("token = 0").select("host", F.col("n_pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    held = sums.where("token <> 0").join(sizes, "host").where(F.col("n_pages") >= F.greatest(F.lit(LEAST_PAGES), SUPPORT * F.col("pages")))
    classes = held.groupBy("host", "vector", "n_pages", "total").agg(F.sort_array(F.collect_list("token")).alias("members"), F.first("pages").alias("pages"))
    numbered = classes.select("host", F.struct(F.xxhash64("vector", "n_pages", "total").alias("class"), "members", ((F.col("total") == F.col("pages")) & (F.col("n_pages") == F.col("pages"))).alias("once")).alias("c"))
    return numbered.groupBy("host").agg(F.sort_array(F.collect_list("c")).alias("classes"))


class Hosts:
    """Brings pages and what is known of their hosts together."""

    def __init__(self, sums: DataFrame):
        self.sizes = sums.where("token = 0").select("host", "n_pages")

    def deal(self, pages: DataFrame, known: DataFrame, size: F.Column):
        """(rows, spread): the pages, and what is known (host, ...; size: its tokens) broadcast as a dict; or both in one
        DataFrame, a host's known row ahead of its pages in every task that has any."""
        if (known.select(F.sum(size)).first()[0] or 0) <= BROADCAST_TOKENS:
            found = {r["host"]: r for r in known.toArrow().to_pylist()}
            return pages.withColumn("is_page", F.lit(True)), pages.sparkSession.sparkContext.broadcast(found)
        line = max(HOST_PAGES, (self.sizes.agg(F.sum("n_pages")).first()[0] or 0) // HOT_HOSTS)
        large = F.broadcast(self.sizes.where(F.col("n_pages") > line).select("host", F.ceil(F.col("n_pages") / line).cast("int").alias("n")))  # HOT_HOSTS at most
        n = F.coalesce("n", F.lit(1))
        rows = pages.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), n).cast("int")).drop("n")
        ahead = known.join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("n")
        both = ahead.withColumn("is_page", F.lit(False)).unionByName(rows.withColumn("is_page", F.lit(True)), allowMissingColumns=True)
        return both.repartition("host", "salt").sortWithinPartitions("host", "salt", "is_page").drop("salt"), None


def pages_with(batches, read, names: list[str], known: list[str], spread):
    """(read(what is known of the host) or None, host, the values of `names`) of every page, and None at the end of a batch."""
    at, found, have = None, None, {}
    for batch in batches:
        hosts, is_page = batch.column("host").to_pylist(), batch.column("is_page").to_pylist()
        columns = [batch.column(c) for c in names]
        for n, (host, page) in enumerate(zip(hosts, is_page, strict=True)):
            if not page:
                at, found = host, read({c: batch.column(c)[n].as_py() for c in known})
                continue
            if spread is None:
                of = found if host == at else None
            else:
                if host not in have:
                    if len(have) >= 1000:
                        have.clear()
                    have[host] = read(spread.value[host]) if host in spread.value else None
                of = have[host]
            yield of, host, [c[n].as_py() for c in columns]
        yield None


def templates(pages: DataFrame, found: DataFrame, hosts: Hosts) -> DataFrame:
    """host, ordered (class, members in order, once), fixed: the template of each host with enough pages."""

    def classes_of(row):
        return {c["class"]: c["members"] for c in row["classes"] if len(c["members"]) > 1}

    def run(batches):
        have: dict[tuple, int] = {}
        for item in pages_with(batches, classes_of, ["tokens"], ["classes"], spread):
            if item is None:
                if len(have) >= FLUSH // 10:
                    yield flush(have)
                    have = {}
                continue
            known, host, (tokens,) = item
            if known:
                for c, order in Page(tokens, [], [], False).orders(known).items():
                    key = (host, c, tuple(order or ()))
                    have[key] = have.get(key, 0) + 1
        if have:
            yield flush(have)

    def flush(have):
        of, classes, orders = zip(*have, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(classes, pa.int64()), pa.array(orders, pa.list_(pa.int64())), pa.array(have.values(), pa.int64())], ["host", "class", "order", "n"])

    dealt, spread = hosts.deal(pages.select("page_id", "url", "host", "tokens"), found, members("classes"))
    votes = heavy_map(dealt, run, "host string, class bigint, order array<bigint>, n bigint").groupBy("host", "class", "order").agg(F.sum("n").alias("n"))
    best = votes.groupBy("host", "class").agg(F.sum("n").alias("pages"), F.max(F.when(F.size("order") > 0, F.struct("n", "order"))).alias("top"))
    agreed = best.where((F.col("top.n") >= SUPPORT * F.col("pages")) & (F.col("top.n") >= LEAST_PAGES)).select("host", "class", F.col("top.order").alias("order"))
    each = found.select("host", F.explode("classes").alias("c"))
    ordered = each.join(agreed.withColumnRenamed("host", "h"), (F.col("host") == F.col("h")) & (F.col("c.class") == F.col("class")), "left")
    kept = F.collect_list(F.when(F.col("order").isNotNull(), F.struct("class", F.col("order").alias("members"), F.col("c.once").alias("once"))))
    fixed = F.flatten(F.collect_list(F.filter("c.members", lambda t: t % 2 == 1)))
    return ordered.groupBy("host").agg(F.sort_array(kept).alias("ordered"), F.sort_array(fixed).alias("fixed"))


def members(name: str) -> F.Column:
    return F.aggregate(name, F.lit(0), lambda n, c: n + F.size(c["members"]))


def template_of(row: dict) -> Template:
    return Template([(c["class"], c["members"], c["once"]) for c in row["ordered"]], row["fixed"])


def slot_roles(pages: DataFrame, found: DataFrame, hosts: Hosts) -> DataFrame:
    """host, roles (slot, role): the slots that are chiefly article or boilerplate, or hold chiefly articles."""

    def run(batches):
        have: dict[tuple[str, int], list[int]] = {}
        for item in pages_with(batches, template_of, ["tokens", "kinds", "sizes"], ["ordered", "fixed"], spread):
            if item is None:
                if len(have) >= FLUSH:
                    yield flush(have)
                    have = {}
                continue
            template, host, (tokens, kinds, sizes) = item
            slots_of = Page(tokens, kinds, sizes, False).read(template) if template else None
            for size, kind, (slots, is_fixed) in zip(sizes, kinds, slots_of or (), strict=False):
                dropped = kind & DROPPED_BLOCK
                if is_fixed and not dropped:
                    continue
                column = 1 if dropped else 0 if kind else 2
                have.setdefault((host, slots[-1] if slots else 0), [0, 0, 0, 0])[column] += size
                for outer in slots[:-1] if column == 0 else ():
                    have.setdefault((host, outer), [0, 0, 0, 0])[3] += size
        if have:
            yield flush(have)

    def flush(have):
        of, slots = zip(*have, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(slots, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*have.values(), strict=True))], ["host", "slot", "article", "boilerplate", "unmarked", "inside"])

    dealt, spread = hosts.deal(pages.select("page_id", "url", "host", "tokens", "kinds", "sizes"), found, members("ordered") + F.size("fixed"))
    sums = heavy_map(dealt, run, "host string, slot bigint, article bigint, boilerplate bigint, unmarked bigint, inside bigint").groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("article", "boilerplate", "unmarked", "inside")])
    role = F.when(F.expr("article > boilerplate + unmarked"), "text").when(F.expr("boilerplate > article + unmarked"), "dropped").when(F.expr("article + inside > boilerplate + unmarked"), "holds")
    return sums.withColumn("role", role).where("role is not null").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "role"))).alias("roles"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    read = cut(parsed(rows))
    sums = cut(occurrence_sums(read.select("page_id", "host", "tokens")))
    hosts = Hosts(sums)
    classes = cut(candidates(sums))
    found = cut(templates(read, classes, hosts))
    roles = slot_roles(read, found, hosts)
    known = cut(found.join(roles, "host", "left"))
    drop(classes, found)

    def known_of(row):
        return template_of(row), {x["slot"]: x["role"] for x in row["roles"] or ()}

    def run(batches):
        ids, urls, texts = [], [], []
        for item in pages_with(batches, known_of, ["page_id", "url", "html"], ["ordered", "fixed", "roles"], spread):
            if item is None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
                ids, urls, texts = [], [], []
                continue
            of_host, _, (page, url, source) = item
            ids.append(page)
            urls.append(url)
            texts.append(Page.of(source).text(*(of_host or ())))

    dealt, spread = hosts.deal(rows, known, members("ordered") + F.size("fixed") + F.coalesce(F.size("roles"), F.lit(0)))
    out = heavy_map(dealt, run, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLE_SQL: dict[str, str] = {}
