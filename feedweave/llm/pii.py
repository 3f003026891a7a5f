r"""Personal data by weak supervision: labelers vote, EM estimates how far to trust them, a classifier decides.

Fixed kinds (email, ip, card, phone; leftmost non-overlapping, failing matches dropped) are always reported.  Looser
patterns add candidates: telephone numbers without a country code, addresses spelt with "at" and "dot", social
security numbers and IBANs (only such as their ranges and check digits allow).  Four labelers look at every candidate, fixed or loose, and vote 1, 0 or abstain (-1):

* regex: the strict form of the kind holds (check digits, field ranges, lengths);
* gazetteer: the top-level domain, the country with its length of account number, the calling or area code or the card issuer is
  a known one, or the number is reserved;
* context: the characters before it (up to 32, back to the last match of its pattern) hold a word that announces the kind, or
  one that announces something else, in English, German, French, Spanish, Italian, Portuguese or Dutch;
* shape: it stands apart from its neighbours, or is glued to letters or digits.

Candidates are counted by (kind, votes, features of the span): at most 8 x 81 x 1,584 cells, whatever the input.  On these counts
EM fits a two-class model with conditionally independent labelers (their reliabilities and the share of true spans
per kind).  Its posteriors are the labels on which the final classifier is trained, a logistic regression that sees the
span and not the votes: for each kind the number of digits and of separators, check digits, digits in a row or repeated, and the
word before it, hashed into WORDS buckets.  So words that often stand before spans which the labelers believe announce
others, in any language.  A loose candidate is reported if its probability is at least ``THRESHOLD`` and no fixed span touches it.

All work on rows is Spark SQL; only the cells reach the driver.

Defined results: a null or empty text has no spans; repeated rows are scanned once each; an empty table gives an empty
table; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import table, texts
from feedweave.llm.spans import SPAN, joined, matches, ordered

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["phone_national", "email_spelt", "ssn", "iban"]
KINDS = BASE + LOOSE
LABELERS = ["regex", "gazetteer", "context", "shape"]
THRESHOLD = 0.5

_LOCAL = "[A-Za-z0-9._%+-]"
#: Anchored at the start of a run of local-part characters, or where the match before ended, so that long runs cost linear time.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SPELT = r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,24}\b"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"

# Top-level domains (besides those of two letters), lengths of account numbers by country, and words that announce a kind.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|cat|tel|post|asia|app|dev|online|site|shop|store|blog|cloud|tech|xyz|club|live|news|email|agency|company|group|world|today|academy|media|design|studio|digital|network|systems|solutions|services|support|center|city|london|berlin|paris|wien|koeln|hamburg|nyc|tokyo|eu"
IBAN_LENGTH = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21"
    " MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
ANNOUNCES = {
    "email": "mail|contact|write|address|kontakt|adresse|courriel|correo|contacto|contatto|escrib|schreib|[ée]crire",
    "ip": "\\bip\\b|host|server|client|serveur|servidor|rechner|adresse",
    "card": "card|visa|master|amex|payment|credit|debit|karte|carte|tarjeta|carta|kaart|cart[ãa]o",
    "phone": "phone|tel|call|fax|mobil|cell|contact|anruf|rufnummer|handy|appel|llam|m[óo]vil|celular|chiama|bellen",
    "phone_national": "phone|tel|call|fax|mobil|cell|contact|anruf|rufnummer|handy|appel|llam|m[óo]vil|celular|chiama|bellen",
    "email_spelt": "mail|contact|write|address|kontakt|adresse|courriel|correo|contacto|contatto|escrib|schreib|[ée]crire",
    "ssn": "ssn|social|security|sozialvers|s[ée]curit|seguridad",
    "iban": "iban|account|bank|konto|compte|cuenta|conto|rekening|banque|banco|banca",
}
DENIES = "version|isbn|issn|license|licence|section|chapter|invoice|order|lizenz|kapitel|rechnung|bestell|chapitre|facture|commande|cap[íi]tulo|factura|pedido"
#: Buckets of the word before a span.
WORDS = 32


def _s(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def luhn(digits: str) -> str:
    """SQL: a string of digits passes the Luhn check."""
    digit = f"cast(substring({digits}, length({digits}) + 1 - i, 1) as int)"
    return f"(aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + if(i % 2 = 1, {digit}, cast(substring('0246813579', {digit} + 1, 1) as int))) % 10 = 0)"


def mod97(account: str) -> str:
    """SQL: an account number without blanks passes its check."""
    value = "if(ch between '0' and '9', ascii(ch) - 48, ascii(ch) - 55)"
    step = f"(acc, ch) -> pmod(acc * if(ch between '0' and '9', 10, 100) + {value}, 97)"
    return f"(aggregate(split(concat(substring({account}, 5), substring({account}, 1, 4)), ''), 0, {step}) = 1)"


def strict(kind: str, v: str) -> str:
    """SQL: what a match of the kind's pattern must hold besides."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    account = f"regexp_replace({v}, ' ', '')"
    return {
        "email": "true",
        "ip": f"forall(split({v}, '[.]'), o -> coalesce(try_cast(o as bigint) <= 255, false))",
        "card": f"(length({d}) between 12 and 19 and {luhn(d)})",
        "phone": f"length({d}) between 9 and 15",
        "phone_national": f"(substring({d}, 1, 1) not in ('0', '1') and substring({d}, 4, 1) not in ('0', '1'))",
        "email_spelt": f"rlike({v}, '[(\\\\[]')",
        "ssn": f"(substring({v}, 1, 3) not in ('000', '666') and substring({v}, 1, 1) <> '9' and substring({v}, 5, 2) <> '00' and substring({v}, 8, 4) <> '0000')",
        "iban": f"(length({account}) between 15 and 34 and {mod97(account)})",
    }[kind]


def gazetteer(kind: str, v: str) -> str:
    """SQL: 1 if a known name or prefix supports the match, 0 if one speaks against it, -1 otherwise."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    known = "array(" + ", ".join(f"'{x}'" for x in IBAN_LENGTH.split()) + ")"
    return {
        "email": f"if(rlike({v}, '(?i)[.](?:{TOP_LEVEL}|[a-z]{{2}})$'), 1, if(rlike({v}, '[.][0-9-]+$'), 0, -1))",
        "ip": f"if(rlike({v}, '^(?:0|10|127|255|192[.]168|169[.]254)[.]'), 0, 1)",
        "card": f"if(rlike({v}, '^(?:4|5[1-5]|2[2-7]|3[47]|6)'), 1, 0)",
        "phone": f"if(rlike({v}, '^[+](?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])'), 1, -1)",
        "phone_national": f"if(rlike({d}, '^[2-9][0-8][0-9][2-9](?!11)[0-9]{{6}}$') and not rlike({d}, '^...55501'), 1, 0)",
        "email_spelt": f"if(rlike({v}, '(?i)(?:{TOP_LEVEL}|\\\\b[a-z]{{2}})$'), 1, 0)",
        "ssn": f"if({v} in ('078-05-1120', '219-09-9999', '123-45-6789'), 0, -1)",
        "iban": f"if(array_contains({known}, concat(substring({v}, 1, 2), length(regexp_replace({v}, ' ', '')))), 1, 0)",
    }[kind]


def _by_kind(of, kinds=KINDS) -> str:
    return "case x.k " + " ".join(f"when '{k}' then {of(k, 'x.v')}" for k in kinds) + " end"


def base_spans(text: str) -> str:
    digit = f"rlike({text}, '[0-9]')"
    keep = lambda kind, pattern, when: f"filter({matches(text, pattern, kind, when)}, x -> {strict(kind, 'x.v')})"
    parts = [
        keep("email", EMAIL, f"contains({text}, '@')"),
        keep("ip", IP, digit),
        keep("card", CARD, digit),
        keep("phone", PHONE, f"contains({text}, '+')"),
    ]
    return ordered(f"concat({', '.join(parts)})", KINDS)


def loose_spans(text: str) -> str:
    digit = f"rlike({text}, '[0-9]{{2}}')"
    parts = [
        matches(text, NATIONAL, "phone_national", digit),
        matches(text, SPELT, "email_spelt", f"rlike({text}, '(?i)[( \\\\[]dot[) \\\\]]')"),
        *(f"filter({matches(text, pattern, kind, digit)}, x -> {strict(kind, 'x.v')})" for kind, pattern in (("ssn", SSN), ("iban", IBAN))),
    ]
    return f"concat({', '.join(parts)})"


def features(v: str, before: str) -> str:
    """SQL: what the classifier sees of a span, as an array of small numbers: digits, separators, oddities, the word before."""
    digits, others = f"length(regexp_replace({v}, '[^0-9]', ''))", f"length(regexp_replace({v}, '[A-Za-z0-9]', ''))"
    odd = f"if(rlike({v}, '([0-9])[^0-9]?\\\\1[^0-9]?\\\\1[^0-9]?\\\\1'), 1, if(rlike({v}, '0123|1234|2345|3456|4567|5678|6789|9876|8765|7654|6543|5432|4321'), 2, 0))"
    word = f"regexp_extract(lower({before}), '(\\\\p{{L}}{{2,}})[^\\\\p{{L}}]{{0,4}}$', 1)"
    return f"array(least({digits} div 4, 3), least({others}, 3), {odd}, if({word} = '', 0, 1 + cast(pmod(xxhash64({word}), {WORDS}) as int)))"


def voted(spans: str) -> str:
    """array<struct<s, e, k, v, votes, f>> for an array of spans; votes is an array of 1, 0 or -1, f of features."""
    context = "case x.k " + " ".join(f"when '{k}' then if(rlike(x.b, '{_s('(?i)(?:' + w + ')')}'), 1, if(rlike(x.b, '(?i)(?:{DENIES})'), 0, -1))" for k, w in ANNOUNCES.items()) + " end"
    shape = "if(rlike(x.b, '[A-Za-z0-9]$') or rlike(coalesce(x.a, ''), '[A-Za-z0-9]'), 0, 1)"
    return f"""transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'v', x.v,
        'votes', array(if({_by_kind(strict)}, 1, 0), {_by_kind(gazetteer)}, {context}, {shape}), 'f', {features('x.v', 'x.b')}))"""


def _logit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Labeler reliabilities by EM, and a logistic classifier of spans, fitted on counted cells (kind, votes, features, n)."""

    def __init__(self, cells: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 60):
        self.kinds = sorted({c[0] for c in cells})
        kind = np.array([self.kinds.index(c[0]) for c in cells], np.int64)
        votes = np.array([c[1] for c in cells], np.int64).reshape(-1, len(LABELERS))
        n = np.array([c[3] for c in cells], np.float64)
        prior = np.full(len(self.kinds), 0.5)
        # P(vote 1 | labeler, class); smoothing keeps every estimate inside (0, 1).
        hit = np.tile([0.3, 0.8], (len(LABELERS), 1))
        post = np.zeros(len(cells))
        for _ in range(rounds if len(cells) else 0):
            score = np.log(prior[kind] / (1 - prior[kind]))
            for j in range(len(LABELERS)):
                p0, p1 = hit[j]
                score += np.select([votes[:, j] == 1, votes[:, j] == 0], [np.log(p1 / p0), np.log((1 - p1) / (1 - p0))], 0.0)
            post = _logit(score)
            prior = (np.bincount(kind, post * n, len(prior)) + 1) / (np.bincount(kind, n, len(prior)) + 2)
            for j in range(len(LABELERS)):
                for z, (a, b) in enumerate(((2, 8), (8, 2))):
                    weight = (post if z else 1 - post) * n
                    hit[j, z] = (weight[votes[:, j] == 1].sum() + a) / (weight[votes[:, j] >= 0].sum() + a + b)
        self.prior = dict(zip(self.kinds, prior.tolist(), strict=True))
        self.reliability = {(j, z): float(hit[j, z]) for j in range(len(LABELERS)) for z in (0, 1)}
        self.posterior = post.tolist()
        self.weights = self._fit(cells, post, n)

    @staticmethod
    def names(kind: str, votes: tuple[int, ...], f: tuple[int, ...]) -> list[str]:
        """The features that are 1 for a span: those of its kind; the first vote says whether the check digits hold."""
        return [f"{kind}", f"{kind} check {votes[0]}", f"{kind} digits {f[0]}", f"{kind} marks {f[1]}", f"{kind} odd {f[2]}", f"{kind} word {f[3]}"]

    def _fit(self, cells, post: np.ndarray, n: np.ndarray, rounds: int = 300) -> dict[str, float]:
        """Gradient steps on the counts per kind; a feature that is rare is held back by the ridge."""
        rows = [self.names(c[0], c[1], c[2]) for c in cells]
        place = {name: i for i, name in enumerate(sorted({x for r in rows for x in r}))}
        at = np.array([[place[x] for x in r] for r in rows], np.int64).reshape(-1, 6)
        w = np.zeros(len(place))
        total = np.zeros(len(place))
        for j in range(at.shape[1]):
            total += np.bincount(at[:, j], n, len(w))
        for _ in range(rounds):
            slip = (post - _logit(w[at].sum(axis=1))) * n
            slope = sum((np.bincount(at[:, j], slip, len(w)) for j in range(at.shape[1])), np.zeros(len(w))) - w
            w += slope / (1.5 * total + 1)
        return {name: float(w[i]) for name, i in place.items()}

    def probability_of(self, kind: str, votes: tuple[int, ...], f: tuple[int, ...]) -> float:
        return float(_logit(np.array(sum(self.weights.get(x, 0.0) for x in self.names(kind, votes, f)))))

    def probability(self) -> str:
        """SQL: probability of the voted candidate c."""
        known = "map(" + ", ".join(f"'{name}', {w!r}D" for name, w in self.weights.items()) + ")" if self.weights else "cast(map() as map<string, double>)"
        names = ["c.k", "concat(c.k, ' check ', c.votes[0])", *(f"concat(c.k, ' {name} ', c.f[{i}])" for i, name in enumerate(("digits", "marks", "odd", "word")))]
        score = " + ".join(f"coalesce(try_element_at({known}, {name}), 0D)" for name in names)
        return f"(1 / (1 + exp(-least(greatest({score}, -30D), 30D))))"


def learn(docs: DataFrame) -> Model:
    text = "text"
    found = docs.select(F.explode(F.expr(voted(f"concat({base_spans(text)}, {loose_spans(text)})"))).alias("c"))
    cells = found.groupBy("c.k", "c.votes", "c.f").count().collect()  # at most 8 x 81 x 1,584 rows
    return Model(sorted((r["k"], tuple(r["votes"]), tuple(r["f"]), r["count"]) for r in cells))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans (arrays of SPAN, in order) for each document."""
    docs = texts(docs, id_col, text_col)
    model = learn(docs)
    rows = docs.withColumn("base", F.expr(base_spans("text")))
    extra = f"""transform(filter({voted(loose_spans("text"))}, c -> {model.probability()} >= {THRESHOLD}D
        and not exists(base, b -> b.s < c.e and c.s < b.e)), c -> cast(named_struct('s', c.s, 'e', c.e, 'k', c.k, 'v', c.v, 'b', '', 'a', '') as {SPAN}))"""
    return rows.select("doc_id", "base", F.expr(ordered(f"concat(base, {extra})", KINDS)).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.k = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans")
    )


QUERIES = {"op5_pii": op5_pii}
ORACLE_SQL: dict[str, str] = {}
