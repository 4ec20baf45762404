"""Scalar functions over turns, prompts and source texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of the text model, glyphs that stand for a running answer, sources that are chats, session ids,
# languages by suffix, and commands with whether they destroy, how they are confirmed, and what they look like.
SPACE_CLASS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_SPACE_CLASS = SPACE_CLASS.replace(r"\n", "")
ARTIFACT_GLYPHS = "▋█▉▊▌▍▎▏⏺⏵●…"
CHAT_SOURCES = ("chat", "browser_ext", "web")
SESSION_ID = r"^[A-Za-z0-9_.\-]{1,256}$"
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx"}
COMMANDS = [
    ("delete_this_chat", True, "single", [
        r"delete\s+this\s+chat\s*(history)?\s*\.?\s*",
        r"wipe\s+memory\s+for\s+this\s+chat\s*\.?\s*",
        r"forget\s+this\s+conversation\s*\.?\s*",
        r"clear\s+memory\s+layer\s+for\s+this\s+chat\s*\.?\s*",
    ]),
    ("delete_all_memory", True, "double", [
        r"delete\s+all\s+(my\s+)?memory(\s+layer)?(\s+data)?\s*\.?\s*",
        r"wipe\s+all\s+memory\s+layer\s+data\s*\.?\s*",
        r"nuke\s+everything\s*\.?\s*",
    ]),
    ("pause", False, "single", [
        r"pause\s+memory\s+layer\s*\.?\s*",
        r"stop\s+tracking\s*\.?\s*",
        r"disable\s+memory\s+layer\s*\.?\s*",
    ]),
    ("show_memory", False, "single", [
        r"what\s+do\s+you\s+remember\s*\??\s*",
        r"show\s+memory\s*\.?\s*",
        r"show\s+me\s+what\s+you('?ve)?\s+saved\s*\.?\s*",
    ]),
]


def strip(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]++|[{SPACE_CLASS}]++\z", "")


def normalize_client_source(source: Column) -> Column:
    """'chat' for the chat sources, 'coding' for anything else, null and empty included."""
    return F.when(F.lower(strip(source)).isin(*CHAT_SOURCES), "chat").otherwise("coding")


def is_valid_external_session_id(value: Column) -> Column:
    """1 to 256 letters, digits, dots, dashes or underscores; null is not valid."""
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9_.\-]{1,256}\z"), F.lit(False))


def parse_recorded_at(text: Column) -> Column:
    """Timestamp of a text with a space or T between date and time; without an offset it is UTC. Null if it is none."""
    return F.try_to_timestamp(strip(text))


def to_iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, 0 at least."""
    return F.greatest((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6), F.lit(0.0))


def age_human(ts: Column, now: Column) -> Column:
    """'just now' within a minute, else whole minutes, hours or days ago."""
    age = seconds_between(now, ts)

    def ago(seconds: int, unit: str) -> Column:
        n = F.floor(age / seconds).cast("long")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(age.isNull(), None).when(age < 60, "just now").when(age < 3600, ago(60, "minute")).when(age < 86400, ago(3600, "hour")).otherwise(ago(86400, "day"))


def tokens_floor4(text: Column) -> Column:
    """A quarter of the characters, which may be 0."""
    return F.floor(F.length(text) / 4).cast("long")


def tokens_min1(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), tokens_floor4(text)).cast("long")


def tokens_code(text: Column) -> Column:
    """The characters divided by 3.5, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(3.5))).cast("long")


def normalize_model(model: Column) -> Column:
    """A model's name without the date it ends in."""
    return F.regexp_replace(model, r"-(\d{8}|\d{4}-\d{2}-\d{2})$", "")


def stable_text(text: Column) -> Column:
    """Line ends as \\n, no white space at line ends, no blank lines at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), rf"[{LINE_SPACE_CLASS}]++(?=\n|\z)", "")
    return F.regexp_replace(lines, r"\A\n++|\n++\z", "")


def stable_hash(text: Column) -> Column:
    """SHA-256 of the stable text: layout at line ends and around the text doesn't matter."""
    return F.sha2(stable_text(text).cast("binary"), 256)


def detect_language(path: Column) -> Column:
    """By the lower-cased extension of the file name; null for others."""
    suffix = file_suffix(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one, or with just a leading or trailing dot."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.*(\.[^.]+)$", 1))


def looks_binary(content: Column) -> Column:
    """A zero byte in the first 8192."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def make_snippet(text: Column, query: str, radius: int = 60) -> Column:
    """The first match, whatever its case, with radius characters around it; the text's start if there is none."""
    at = F.instr(F.lower(text), F.lit(query.lower()))
    start, end = F.greatest(F.lit(0), at - 1 - radius), F.least(F.length(text), at - 1 + len(query) + radius)
    cut = strip(F.substring(text, start + 1, end - start))
    around = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").when(at > 0, around).otherwise(strip(F.substring(text, 1, 2 * radius)))


def hash_embedding(text: Column, dim: int = 768) -> Column:
    """The bytes of the text's SHA-256, over and over, divided by 255: a stand-in for an embedding. Null for a null text."""
    digest = F.sha2(text.cast("binary"), 256)
    values = F.transform(F.regexp_extract_all(digest, F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("double") / F.lit(255.0))
    return F.slice(F.flatten(F.array_repeat(values, -(-dim // 32))), 1, dim)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is zero, null, or of another length."""
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def clean_turn_text(text: Column) -> Column:
    """No-break spaces as spaces, runs of \\r and \\t as one space, no more than one blank line, no outer white space."""
    spaced = F.regexp_replace(F.regexp_replace(text, "\u00a0", " "), "[\r\t]+", " ")
    return strip(F.regexp_replace(spaced, "\n{3,}", "\n\n"))


def is_streaming_artifact(text: Column) -> Column:
    """Nothing but white space, control characters and the glyphs that chats show while they wait. Null is one."""
    return F.coalesce(text.rlike(rf"\A([\x00-\x20{ARTIFACT_GLYPHS}]*|[{SPACE_CLASS}]*)\z"), F.lit(True))


def classify_command(text: Column) -> Column:
    """struct(command, destructive, confirmation) of the first command that the whole text is; null if it is none."""
    out = F.lit(None).cast("struct<command:string,destructive:boolean,confirmation:string>")
    for name, destructive, level, patterns in reversed(COMMANDS):
        found = text.rlike(rf"(?i)\A\s*({'|'.join(patterns)})\z")
        value = F.struct(F.lit(name).alias("command"), F.lit(destructive).alias("destructive"), F.lit(level).alias("confirmation"))
        out = F.when(found, value).otherwise(out)
    return out


def djb2(text: Column) -> Column:
    """h = h * 33 xor c, mod 2**32, from 5381 over the UTF-16 units."""
    step = lambda h, unit: (h * 33).bitwiseXOR(unit).bitwiseAND(F.lit(0xFFFFFFFF))

    def char(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(point - 0x10000, 10), F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(point < 0x10000, step(h, point)).otherwise(step(step(h, high), low))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(5381).cast("long"), char)


def render_turn(role: Column, text: Column) -> Column:
    """[ROLE] text; a null role is the assistant."""
    return F.concat(F.lit("["), F.upper(F.coalesce(role, F.lit("assistant"))), F.lit("] "), text)


def render_prompt(context: Column, draft: Column) -> Column:
    """The draft after its context, each in its envelope; the draft alone if there is no context."""
    both = F.concat(F.lit("<Established_Context>\n"), context, F.lit("\n</Established_Context>\n\n<Active_Prompt>\n"), draft, F.lit("\n</Active_Prompt>"))
    return F.when(F.coalesce(F.length(strip(context)), F.lit(0)) == 0, draft).otherwise(both)


def compress_context(text: Column, most: int = 600) -> Column:
    """The stripped text if it fits; else cut at the last line end beyond half of it, or at the last space, or hard."""
    trimmed = strip(text)
    head = F.substring(trimmed, 1, most + 1)
    last = lambda c: F.length(head) - F.instr(F.reverse(head), F.lit(c))  # noqa: E731  0-based place of the last c
    line, space = last("\n"), last(" ")
    has = lambda c: F.instr(head, F.lit(c)) > 0
    at_line = F.concat(F.regexp_replace(F.substring(trimmed, F.lit(1), line), rf"[{SPACE_CLASS}]++\z", ""), F.lit("\n…"))
    at_space = F.concat(F.substring(trimmed, F.lit(1), space), F.lit("…"))
    cut = F.when(has("\n") & (line > most / 2), at_line).when(has(" ") & (space > 0), at_space).otherwise(F.concat(F.substring(trimmed, 1, most), F.lit("…")))
    return F.when(trimmed.isNull(), "").when(F.length(trimmed) <= most, trimmed).otherwise(cut)


def file_uri_to_path(uri: Column) -> Column:
    """Path of a file:// URI, null for any other; no slash before a drive letter."""
    path = F.url_decode(F.regexp_replace(F.substring(uri, F.lit(8), F.length(uri)), r"^[^/]*", ""))
    return F.when(uri.startswith("file://"), F.regexp_replace(path, r"^/(?=[A-Za-z]:)", ""))


def per_token_to_per_million(value: Column) -> Column:
    """A price text per token as one per million tokens, to 6 places; null unless it is a number above 0."""
    number = value.try_cast("double")
    return F.when(number > 0, F.round(number * 1_000_000, 6))


def project_id_from_path(path: Column) -> Column:
    """ts:<name>:<8 hex digits>, the digits being the first of the path's SHA-256."""
    name = file_name(F.regexp_replace(path, r"/+$", ""))
    return F.concat(F.lit("ts:"), name, F.lit(":"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8))


def display_cost(context: Column, compressed: Column) -> Column:
    """struct(tokens, usd) that compression saves: a quarter of the characters, at 0.00003 dollars each, to 5 places."""
    saved = F.greatest(F.lit(0), F.length(context) - F.length(compressed))
    tokens = F.floor(saved / 4 + 0.5).cast("long")
    return F.struct(tokens.alias("tokens"), F.round(tokens * F.lit(0.00003), 5).alias("usd"))


def url_session(url: Column, pattern: Column, path_filter: Column) -> Column:
    """First group of the host's pattern in path, query and fragment; null if there is none or the path filter isn't in it."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    found = F.nullif(F.call_function("regexp_extract", rest, pattern, F.lit(1)), F.lit(""))
    return F.when(path_filter.isNull() | F.contains(rest, path_filter), found)
