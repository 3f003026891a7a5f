"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding.  For every prefix of a pre-token there is exactly one token that can end its encoding: the token t
that ends there and whose predecessor (the last token of the prefix before t) keeps its boundary when the two
are encoded together.  Reading one symbol therefore extends a table of (last token, back pointer) by one row.
A future symbol can only point back to the rows of the last ``max_token`` positions; tokens on which the back
pointers of all of those rows agree can no longer change.  ``sufficient_lookahead``, computed from the merge list,
bounds how far right an undecided boundary can depend on unread symbols: whenever that many symbols are undecided, the
agreed tokens are emitted and their rows forgotten, so the table keeps a constant number of rows, however long the
pre-token is.  Every pre-token goes through the transducer; results of short ones are remembered.  Texts are read in slices,
and tokens handed on slice by slice.

Decoding is an incremental state machine from bytes to text: ids go in as they come, text comes out as soon as it is
complete (for byte-level vocabularies: as soon as the UTF-8 sequence is).  Where the tokenizer names no decoder, the bytes
of a token are those of its name, with a space between tokens.

Only a row's own results are held whole, because a row is what Arrow hands on.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows are encoded
once each; an empty table gives an empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import heavy_map, table, texts

#: Word encodings that a worker remembers before older ones go (beginnings and pairs of tokens: a third as many); symbols of a beginning.
CACHE_WORDS, START = 800_000, 8
#: Words that it remembers between tasks.
KEEP_WORDS = 50_000
#: Longer words are not remembered.
CACHE_CHARS = 64
#: Characters of text that are encoded together, up to the next white space.
SLICE = 1 << 16
#: Bytes of results gathered before an Arrow batch goes out.
OUT_BYTES = 4 << 20
_BLANK = re.compile(r"\s")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """A merge list with an optional end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", room: int | None = None):
        self.vocab, self.suffix, self.room = vocab, suffix, (room or CACHE_WORDS) // 3
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.names = {i: t for t, i in vocab.items()}
        self.max_token = max((len(self.symbols_of(t)) for t in vocab), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.selves: dict[str, bool] = {}
        self.spines: dict[str, tuple] = {}
        self.starts: dict[str, tuple[str, int]] = {}

    def symbols_of(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals: the definition that everything else is tested against."""
        n, rank = len(symbols), self.rank
        if n < 2:
            return symbols
        if n <= 128:
            symbols, far = list(symbols), len(rank)
            ranks = [rank.get(pair, far) for pair in zip(symbols, symbols[1:])]
            while ranks:
                low = min(ranks)
                if low == far:
                    break
                at = ranks.index(low)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank.get((symbols[at - 1], symbols[at]), far)
                if at < len(ranks):
                    ranks[at] = rank.get((symbols[at], symbols[at + 1]), far)
            return symbols
        part, right, left = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] == a else -1
            if j < 0 or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [x for x in part if x]

    def fits(self, a: str, b: str) -> bool:
        """Whether the boundary between two adjacent tokens is kept when they are encoded together."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.room:
                self.pairs.clear()
            known = self.pairs[a, b] = self._kept(a, b)
        return known

    def _kept(self, a: str, b: str) -> bool:
        """No pair (right edge of a, left edge of b) is merged while both are edges; of equal ranks the left one comes first."""
        rank = self.rank
        for x, x_from, x_to in self.edges(a)[1]:
            for y, y_from, y_to in self.edges(b)[0]:
                r = rank.get((x, y))
                if r is not None and x_from <= r < x_to and y_from <= r <= y_to:
                    return False
        return True

    def edges(self, token: str):
        """The left and the right edges of a token as it is built from symbols: (edge, rank it comes by, rank it goes by)."""
        if (known := self.spines.get(token)) is None:
            far, part, built = len(self.rank), self.symbols_of(token), {}
            span = [(i, i + 1) for i in range(len(part))]
            made = {s: -1 for s in span}
            while len(part) > 1:
                r, i = min((self.rank.get(pair, far), i) for i, pair in enumerate(zip(part, part[1:])))
                if r == far:
                    break
                part[i : i + 2] = [part[i] + part[i + 1]]
                span[i : i + 2] = [(span[i][0], span[i + 1][1])]
                made[span[i]] = r
                built[span[i]] = part[i]
            symbols = self.symbols_of(token)
            sides = []
            for at, edge in ((0, 0), (1, len(symbols))):
                steps = sorted((s for s in made if s[at] == edge), key=lambda s: s[1] - s[0])
                sides.append([(built.get(s) or symbols[s[0]], made[s], made[t] if t else far) for s, t in zip(steps, [*steps[1:], None])])
            known = self.spines[token] = tuple(sides)
        return known

    @functools.cached_property
    def longest(self) -> dict[str, int]:
        """Characters of the longest token that ends with a symbol, for each last symbol."""
        out: dict[str, int] = {}
        for t in self.vocab:
            x = self.symbols_of(t)[-1]
            out[x] = max(out.get(x, 0), len(t))
        return out

    def whole(self, token: str) -> bool:
        """The token is what its own symbols are encoded to."""
        if (known := self.selves.get(token)) is None:
            known = self.selves[token] = self.merge(self.symbols_of(token)) == [token]
        return known

    @functools.cached_property
    def sufficient_lookahead(self) -> int:
        """Symbols to the right that can decide a boundary.

        A merge (a, b) can be prevented only by an earlier merge (b', c) of the right edge b' of b, which in turn
        only by an earlier one, and so on: ranks fall along such a chain, so one pass in rank order finds the
        longest reach.
        """
        edge: dict[str, tuple[str, str]] = {a + b: (a, b) for a, b in self.rank}
        best: dict[str, int] = {}
        most = 0
        for a, b in self.rank:
            reach, x = 0, b
            while True:
                reach = max(reach, best.get(x, 0))
                if x not in edge:
                    break
                x = edge[x][1]
            best[a] = max(best.get(a, 0), len(self.symbols_of(b)) + reach)
            most = max(most, best[a])
        return most + self.max_token


class Transducer:
    """Encodes one pre-token symbol by symbol; feed() returns the tokens that have become stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.read = self.emitted = 0
        self.last: dict[int, tuple[str, int]] = {}  # position -> (the token that ends there, where it starts)
        self.recent = ""  # the last symbols, max_token of them at most
        self.edge: str | None = None  # the last token emitted

    def step(self, symbol: str) -> None:
        m, last, emitted, at = self.m, self.last, self.emitted, self.read
        vocab, selves, pairs = m.vocab, m.selves, m.pairs
        self.recent = recent = self.recent[-m.max_token :] + symbol
        self.read = at + 1
        long = len(symbol)
        size = min(len(recent), at - emitted + long, m.longest.get(symbol, long))
        while size >= long:
            token = recent[-size:]
            if token in vocab and (selves.get(token) or m.whole(token)):
                before = at + long - size
                if before == emitted:
                    left = self.edge
                elif before in last:
                    left = last[before][0]
                else:
                    size -= 1
                    continue
                fits = True if left is None else pairs.get((left, token))
                if fits or fits is None and m.fits(left, token):
                    last[at + 1] = (token, before)
                    return
            size -= 1
        raise ValueError(f"no token ends with {symbol!r}")

    def stable(self) -> list[str]:
        """Tokens shared by the back pointers of every row that a future symbol can reach."""
        heap = [-p for p in range(max(self.emitted, self.read - self.m.max_token + 1), self.read + 1) if p in self.last or p == self.emitted]
        heapq.heapify(heap)
        while heap and any(-p != -heap[0] for p in heap):
            p = -heapq.heappop(heap)
            while heap and -heap[0] == p:
                heapq.heappop(heap)
            heapq.heappush(heap, -self.last[p][1] if p in self.last and p != self.emitted else -self.emitted)
        return self.take(-heap[0] if heap else self.emitted)

    def take(self, to: int) -> list[str]:
        out, at = [], to
        while at > self.emitted:
            token, at = self.last[at]
            out.append(token)
        out.reverse()
        if out:
            self.edge, self.emitted = out[-1], to
            self.last = {p: x for p, x in self.last.items() if p > to}
        return out

    def feed(self, symbols: list[str]) -> list[str]:
        out, most = [], 2 * self.m.sufficient_lookahead
        for s in symbols[self.begin(symbols) :]:
            self.step(s)
            if self.read - self.emitted > most:
                out += self.stable()
        return out

    def begin(self, symbols: list[str]) -> int:
        """The rows of the first symbols, which depend on these only and are remembered; how many were read."""
        if self.read:
            return 0
        starts, part = self.m.starts, ""
        for n, s in enumerate(symbols[: min(START, len(symbols) - 1)], 1):
            part += s
            row = starts.get(part)
            if row is None:
                self.step(s)
                if len(starts) > self.m.room:
                    starts.clear()
                starts[part] = self.last[n]
            else:
                self.last[n] = row
                self.read, self.recent = n, part
        return self.read

    def finish(self) -> list[str]:
        return self.take(self.read)


class WordTokenizer:
    """A tokenizer file with lower-casing, a splitting pattern, byte alphabet and word ends.

    encode() equals the public library's encode(text, add_special_tokens=False), decode() its
    decode(ids, skip_special_tokens=False).
    """

    def __init__(self, path: str, room: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "", room)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        names = self.merges.names | {i: t for t, i in self.special.items()}
        self.raw = {i: t.encode() for i, t in names.items()}
        self.bytes = byte_alphabet()
        self.packed = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        self.parts = _Remembered(self.pre_token, room or CACHE_WORDS)
        self.words = _Remembered(self.chunk, room or CACHE_WORDS)

    def pre_token(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a pre-token."""
        if word.isascii() and word.isprintable():
            symbols = list(word)
        else:
            symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.merges.suffix
        t = Transducer(self.merges)
        return b"".join([self.packed[x] for x in t.feed(symbols) + t.finish()])

    def chunk(self, raw: str) -> bytes:
        """Ids of a piece of text without white space at its ends."""
        text = raw.lower() if raw.isascii() else unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()
        parts = self.pattern.findall(text)
        if parts == [raw]:
            return self.pre_token(raw)
        # A part of plain letters is a piece of its own, and remembered as such.
        words, others = self.words, self.parts
        return b"".join([words[x] if x.isascii() and x.isalpha() else others[x] for x in parts])

    def plain(self, text: str):
        """Ids of a text without special tokens, slice by slice."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, not for the pattern
            yield self.chunk(text)
            return
        words, at = self.words, 0
        while at < len(text):
            end = at + SLICE
            if end < len(text) and (blank := _BLANK.search(text, end)):
                end = blank.start()
            elif end < len(text):
                end = len(text)
            yield b"".join([words[w] for w in text[at:end].split()])
            at = end

    def stream(self, text: str):
        """Ids of a text, as little-endian 32-bit integers, slice by slice."""
        if self.special_pattern is None or "<|" not in text:
            yield from self.plain(text)
            return
        at = 0
        for m in self.special_pattern.finditer(text):
            yield from self.plain(text[at : m.start()])
            yield self.special[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self.plain(text[at:])

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def rest(self) -> None:
        """Between tasks, when the worker may serve others: only the words met first, the frequent ones among them, are kept."""
        for results in (self.words, self.parts):
            results.old = {}
            if len(results) > KEEP_WORDS:
                first = dict(itertools.islice(results.items(), KEEP_WORDS))
                results.clear()
                results.update(first)
        self.merges.starts.clear()

    def decoder(self) -> ByteDecoder:
        return ByteDecoder(self.raw, " ")

    def decode(self, ids: bytes) -> str:
        d = self.decoder()
        return d.feed(memoryview(ids).cast("I")) + d.finish()


class _Remembered(dict):
    """Results by word.  When half of the room is full, what was not asked for since it was last full goes."""

    def __init__(self, make, room: int = CACHE_WORDS):
        super().__init__()
        self.make, self.room, self.old = make, room // 2, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def byte_level(names: dict[int, str], suffix: str = "") -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary stands for; the end of a word is a space."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    return {i: bytes(back[c] for c in t.removesuffix(suffix) if c in back) + (b" " if suffix and t.endswith(suffix) else b"") for i, t in names.items()}


class ByteDecoder:
    """Text of ids: a UTF-8 state machine over the bytes of each id, which holds back an unfinished character.

    between goes between the texts of two ids; ids that are not known are left out.
    """

    def __init__(self, raw: dict[int, bytes], between: str = ""):
        self.raw, self.between = raw, between.encode()
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids) -> str:
        raw = self.raw
        known = [raw[i] for i in ids if i in raw]
        if not known:
            return ""
        lead = self.between if self.begun else b""
        self.begun = True
        return self.state.decode(lead + self.between.join(known))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


@functools.lru_cache(2)
def tokenizer(path: str, room: int | None = None) -> WordTokenizer:
    return WordTokenizer(path, room)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int | None = None, decode: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (decode=False: without).

    room: word encodings that a worker remembers, CACHE_WORDS if not given; fewer take more time.
    """

    def run(batches):
        t = tokenizer(path, room)
        for batch in batches:
            ids, out, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                decoder, code, back = t.decoder(), [], []
                for some in t.stream(text.as_py()):
                    code.append(some)
                    if decode:
                        back.append(decoder.feed(memoryview(some).cast("I")))
                back.append(decoder.finish())
                code, back = b"".join(code), "".join(back)
                ids.append(doc)
                out.append((code, len(code) // 4, back))
                size += len(code) + len(back)
                if size >= OUT_BYTES:
                    yield rows(ids, out)
                    ids, out, size = [], [], 0
            if ids:
                yield rows(ids, out)
        t.rest()

    def rows(ids, out):
        a, b, c = zip(*out, strict=True)
        made = {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(a, pa.binary()), "n_tokens": pa.array(b, pa.int64())}
        return pa.RecordBatch.from_pydict(made | ({"decoded": pa.array(c, pa.string())} if decode else {}))

    return heavy_map(texts(docs, id_col, text_col), run, "doc_id bigint, ids binary, n_tokens bigint" + (", decoded string" if decode else ""))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), word_bpe_path())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
