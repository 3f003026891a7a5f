"""Dates, durations, hashes, URLs, object names and messages, as SQL expressions."""

from __future__ import annotations

from feedweave.functions.text import SPARK, Dialect

# Fixed values.
AUDIO = ("mp3", "m4a", "aac", "wav", "flac", "ogg", "mp4", "opus")
DATE_TIERS = ((2, 1.0), (10, 0.7), (35, 0.15))
MIN_SEGMENT = 0.1
WATCH_URL = r"(https?://)?(www\.)?(youtube\.com|youtu\.be)/watch\?v=([A-Za-z0-9_-]+)"
LINK = r"https?://[^ \t\n\r\f]+"
CHANNEL_FORMS = (
    (r"^https?://(www\.)?youtube\.com/@([A-Za-z0-9_-]+)(/videos)?$", 2, "https://www.youtube.com/@", "/videos"),
    (r"^yt://@([A-Za-z0-9_-]+)$", 1, "https://www.youtube.com/@", "/videos"),
    (r"^yt://#([A-Za-z0-9_-]+)$", 1, "https://www.youtube.com/playlist?list=", ""),
    (r"^https?://(www\.)?youtube\.com/playlist\?list=([A-Za-z0-9_-]+)$", 2, "https://www.youtube.com/playlist?list=", ""),
)
#: Reason of a failed fetch: (any of these), looked for in lower case if the flag is set; the first that is found holds.
REASONS = (
    ("age-restricted; retrying with authentication", (("Sign in to confirm your age", False),)),
    ("premiere not yet available", (("Premieres in ", False),)),
    ("live event not yet started", (("This live event will begin in", False),)),
    ("private video", (("private video", True), ("This video is private", False))),
    ("members-only video", (("members-only", True), ("channel members", True))),
    ("geo-restricted video", (("available in your country", True), ("geo&block", True))),
    ("removed video", (("This video has been removed", False), ("This video is no longer available", False))),
    ("video unavailable", (("Video unavailable", False),)),
    ("requested format is not available", (("Requested format is not available", False),)),
    ("restricted format set; trying fallback", (("This video is only available for", False),)),
)


def parse_duration(x: str, d: Dialect = SPARK) -> str:
    """Seconds of S, M:S or H:M:S; null for anything else."""
    cast = "try_cast({} as double)"
    part = (lambda i: cast.format(f"split({x}, ':')[{i}]")) if d.spark else (lambda i: cast.format(f"string_split({x}, ':')[{i + 1}]"))
    size = f"size(split({x}, ':'))" if d.spark else f"len(string_split({x}, ':'))"
    return f"case when {x} = '' then null when {size} = 1 then {part(0)} when {size} = 2 then 60 * {part(0)} + {part(1)} when {size} = 3 then 3600 * {part(0)} + 60 * {part(1)} + {part(2)} end"


def unix_timestamp(x: str, d: Dialect = SPARK) -> str:
    """A timestamp from digits; null for other text."""
    return f"timestamp_seconds(try_cast({x} as bigint))" if d.spark else f"make_timestamp(try_cast({x} as bigint) * 1000000)"


def compact_date(x: str, d: Dialect = SPARK) -> str:
    """A date from exactly eight digits YYYYMMDD; null for other text."""
    if d.spark:
        return f"case when rlike({x}, '^[0-9]{{8}}$') then cast(try_to_timestamp({x}, 'yyyyMMdd') as date) end"
    return f"case when regexp_matches({x}, '^[0-9]{{8}}$') then cast(try_strptime({x}, '%Y%m%d') as date) end"


#: Date formats of feeds, tried in order.
FEED_DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def feed_date(x: str) -> str:
    """A timestamp from any of FEED_DATES (UTC where no zone is given); null for other text."""
    quoted = (f.replace("'", "\\'") for f in FEED_DATES)
    plain = f"regexp_replace({x}, '^[A-Za-z]{{3}}, ', '')"
    tries = [f"try_to_timestamp({x}, '{f}')" if not f.startswith("EEE, ") else f"try_to_timestamp({plain}, '{f[5:]}')" for f in quoted]
    return f"coalesce({', '.join(tries)})"


def date_similarity(a: str, b: str, d: Dialect = SPARK, tiers=DATE_TIERS, truncate: bool = False) -> str:
    """Tiered by whole days apart: floor then absolute value, so -60 hours are 3 days and +60 hours 2; truncate: 2 both ways."""
    micros = f"({_micros(a, d)} - {_micros(b, d)}) / 86400000000.0"
    days = f"floor(abs({micros}))" if truncate else f"abs(floor({micros}))"
    return f"case when {a} is null or {b} is null then 0.0 " + " ".join(f"when {days} <= {n} then {s!r}" for n, s in tiers) + " else 0.0 end"


def epoch_seconds(x: str, d: Dialect = SPARK) -> str:
    """Whole seconds since 1970, the fraction cut off towards zero; a time without a zone is UTC."""
    return f"cast({_micros(x, d)} / 1000000 as bigint)" if d.spark else f"trunc({_micros(x, d)} / 1000000.0)::BIGINT"


def _micros(x: str, d: Dialect) -> str:
    return f"unix_micros(cast({x} as timestamp))" if d.spark else f"epoch_us({x})"


def md5_prefix(x: str, n: int) -> str:
    return f"substring(md5({x}), 1, {n})"


def video_id(x: str, d: Dialect = SPARK) -> str:
    return f"nullif({d.group(x, WATCH_URL, 4)}, '')"


def channel_url(x: str, d: Dialect = SPARK) -> str:
    """The canonical form of the four channel and playlist spellings; null for others."""
    cases = " ".join(f"when {d.test(x, p)} then concat('{head}', {d.group(x, p, g)}, '{tail}')" for p, g, head, tail in CHANNEL_FORMS)
    return f"case {cases} end"


def stem(x: str, d: Dialect = SPARK) -> str:
    """An object's name without its last suffix; a leading dot is no suffix."""
    return d.sub(x, r"([^/])\.[^./]+$", r"\1")


def suffix(x: str, d: Dialect = SPARK) -> str:
    return d.group(f"lower({x})", r"[^/](\.[^./]+)$", 1)


def is_audio_name(x: str, d: Dialect = SPARK) -> str:
    return f"{d.group(x, r'[^/](\.[^./]+)$', 1)} in ({', '.join(f"'.{e}'" for e in AUDIO)})"


def is_audio_url(x: str, d: Dialect = SPARK) -> str:
    """An audio extension anywhere in the URL."""
    return d.test(x, r"\.(" + "|".join(AUDIO) + ")")


def byte_format(x: str, d: Dialect = SPARK) -> str:
    """A size in B to PB with one decimal, ties to even."""
    units = ("B", "KB", "MB", "GB", "TB")
    shown = lambda v: f"format_string('%.1f', bround({v}, 1))" if d.spark else f"format('{{:.1f}}', {v})"
    cases = " ".join(f"when abs({x}) < {1024 ** (i + 1)} then concat({shown(f'cast({x} as double) / {1024**i}')}, ' {u}')" for i, u in enumerate(units))
    return f"case when {x} is null then null {cases} else concat({shown(f'cast({x} as double) / {1024**5}')}, ' PB') end"


def error_reason(x: str, d: Dialect = SPARK) -> str:
    """Why a fetch failed, from its message; the first line's first 160 characters where no rule holds."""

    def found(what: str, low: bool) -> str:
        return " and ".join(f"contains({f'lower({x})' if low else x}, '{w}')" for w in what.split("&"))

    cases = " ".join(f"when {' or '.join(found(*w) for w in ws)} then '{reason}'" for reason, ws in REASONS)
    newline = "'\\n'" if d.spark else "chr(10)"
    return f"case {cases} else substring(trim(split_part({x}, {newline}, 1)), 1, 160) end"


def bit_rate(source: str, target: str, forced: str = "false") -> str:
    """The encoder's bit rate: the target, not above the source's unless forced; null without a target."""
    return f"case when {target} is null then null when {forced} or {source} is null then {target} else least({source}, {target}) end"


def progress(status: str, done: str, total: str, fragment: str, fragments: str) -> str:
    """Share of a transfer that is done, from a report's fields: finished, bytes, or fragments."""
    return (
        f"case when {status} = 'finished' then 1.0 when {total} > 0 and {done} is not null then least(1.0, cast({done} as double) / {total}) "
        f"when {fragments} > 0 and {fragment} is not null then least(1.0, cast({fragment} as double) / {fragments}) end"
    )
