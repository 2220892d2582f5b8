"""Text normalisation and extraction as Column functions.

Patterns spell out ASCII word boundaries, since `\\b` of the JVM also counts letters outside ASCII as word characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon as L

START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _decompositions() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks and wide forms whose base is one other letter, and those bases."""
    pairs = []
    for code in [*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not "̀" <= c <= "ͯ")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _decompositions()
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without accents; null is empty."""
    out = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN), "[\\u0300-\\u036f]", "")
    for letter, plain in L.LETTER_FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def squeezed(folded: Column) -> Column:
    """Tokens of folded text between single spaces: dots go, & is a word, all else separates."""
    out = F.replace(F.replace(folded, F.lit("."), F.lit("")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def normalize_text(text: Column) -> Column:
    return squeezed(fold(text))


def _tokens(spaced: Column) -> Column:
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def normalize_company(name: Column) -> Column:
    """A company without its domain ending, article, legal form and hiring noise; one token always stays."""
    out = squeezed(F.regexp_replace(fold(name), rf"\.(?:{'|'.join(L.COMPANY_TLDS)}){END}", " "))
    out = F.regexp_replace(out, "^(?:the )+(?=.)", "")
    return F.regexp_replace(out, rf"(?: (?:{'|'.join(L.LEGAL_SUFFIXES + L.COMPANY_EDGE_NOISE)}))+$", "")


def is_placeholder_company(normalized: Column) -> Column:
    return (normalized == "") | normalized.isin(L.PLACEHOLDER_COMPANIES)


def _decorative(tokens: Column) -> Column:
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(L.DECORATION_TOKENS))


def normalize_title(title: Column) -> Column:
    """The role in a title, without places, contract forms, gender tags and other decoration."""
    bracket = r"[(\[{]([^)\]}]*)[)\]}]"
    edge = "|".join(L.EDGE_TOKENS)

    def kept(inner: Column) -> Column:
        useful = let(_tokens(squeezed(inner)), lambda tokens: (F.size(tokens) > 0) & ~_decorative(tokens))
        return F.when(inner.isNull(), "").when(useful, F.concat(F.lit(" "), inner, F.lit(" "))).otherwise(" ")

    def outside(text: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(bracket), F.lit(1))
        return F.array_join(F.zip_with(F.split(text, bracket, -1), groups, lambda part, inner: F.concat(part, kept(inner))), "")

    def chosen(segments: Column) -> Column:
        good = F.filter(segments, lambda s: (F.size(s) > 0) & ~_decorative(s))
        longest = F.aggregate(segments, F.array().cast("array<string>"), lambda best, s: F.when(F.size(s) > F.size(best), s).otherwise(best))
        return let(good, lambda g: F.when(F.size(g) > 0, F.flatten(g)).otherwise(longest))

    def bare(words: Column) -> Column:
        stripped = F.regexp_replace(F.regexp_replace(words, f"^(?:(?:{edge}) )+(?=.)", ""), f"(?: (?:{edge}))+$", "")
        return F.when(_decorative(_tokens(words)), words).otherwise(stripped)

    text = F.regexp_replace(let(fold(title), outside), rf"{START}[mwfdhvx](?:\s*[/\-–]\s*[mwfdhvx])+{END}", " ")
    segments = F.transform(F.split(text, r"\s[-–—]\s|[|,:;•·]", -1), lambda s: _tokens(squeezed(s)))
    words = F.concat(F.lit(" "), F.array_join(let(segments, chosen), " "), F.lit(" "))
    for phrase, word in L.PHRASE_RULES:
        words = F.regexp_replace(words, f"(?<![a-z0-9]){phrase}(?![a-z0-9])", word)
    return let(F.trim(words), bare)


def _mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def location_bucket(location: Column, remote: Column, tables: tuple[dict[str, str], ...] = (L.COUNTRIES, L.STATES, L.CITIES)) -> Column:
    """remote unless remote is false; else a country or region code, unknown, or the last part of the place.

    tables: names and their codes; a hit in an earlier table counts before one in a later table.
    """
    def keys(segment: Column) -> Column:
        def of(tokens: Column) -> Column:
            def with_plain(plain: Column) -> Column:
                joined = F.when((F.size(plain) > 0) & (F.size(plain) != F.size(tokens)), F.array(F.array_join(plain, " "))).otherwise(F.array().cast("array<string>"))
                return F.concat(F.array(segment), joined, F.filter(plain, lambda t: F.length(t) > 2))

            return let(F.filter(tokens, lambda t: ~t.isin(L.LOCATION_NOISE)), with_plain)

        return let(_tokens(segment), of)

    def first_hit(every: Column, table: dict[str, str]) -> Column:
        return F.get(F.filter(F.transform(every, lambda k: F.try_element_at(_mapping(table), k)), lambda c: c.isNotNull()), F.lit(0))

    def known(segments: Column) -> Column:
        hit = let(F.flatten(F.transform(segments, keys)), lambda every: F.coalesce(*[first_hit(every, t) for t in tables]))
        return F.coalesce(hit, F.try_element_at(segments, F.lit(-1)), F.lit("unknown"))

    def bucket(folded: Column) -> Column:
        parts = F.transform(F.split(folded, r"[,/|;()]|\s[-–]\s", -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
        place = let(F.filter(parts, lambda s: s != ""), known)
        return let(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), lambda flat: (
            F.when(flat == "", "unknown").when(flat.rlike(rf"{START}(?:{'|'.join(L.REMOTE_HINTS)}){END}"), "remote").when(flat.isin(L.MEANINGLESS_LOCATIONS), "unknown").otherwise(place)
        ))

    folded = F.regexp_replace(F.replace(fold(location), F.lit("."), F.lit("")), r"[^a-z0-9,/|;()\-–\s]+", " ")
    return F.when(F.coalesce(remote, F.lit(True)), "remote").otherwise(let(folded, bucket))


def _or(text: Column, other: str) -> Column:
    return F.when(text == "", other).otherwise(text)


def fingerprint_job(title: Column, company: Column, location: Column, remote: Column) -> Column:
    name = let(normalize_company(company), lambda n: F.when(is_placeholder_company(n), "anon").otherwise(n))
    return F.concat_ws("|", name, let(normalize_title(title), lambda t: _or(t, "untitled")), location_bucket(location, remote))


def fingerprint_lead(title: Column, client: Column) -> Column:
    name = normalize_company(client)
    anonymous = F.concat_ws("|", F.lit("anon"), _or(normalize_text(title), "untitled"), F.lit("lead"))
    return F.when(is_placeholder_company(name), anonymous).otherwise(F.concat_ws("|", name, _or(normalize_title(title), "untitled"), F.lit("lead")))


def decode_entities(text: Column) -> Column:
    """The ten known entities; any other named or numbered one is a space."""
    out = text
    for name, char in sorted(L.ENTITIES.items(), key=lambda e: e[0] == "amp"):
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", char)
    out = F.regexp_replace(out, r"(?i)&(?!amp;)(?:[a-z]+|#\d+);", " ")
    return F.regexp_replace(out, "(?i)&amp;", "&")


def _where(text: Column, letters: str, change: Callable[[Column], Column]) -> Column:
    """The changed text where it has the letters, without which the change does nothing; else the text."""
    return let(text, lambda t: F.when(t.contains(letters), change(t)).otherwise(t))


def informative_length(text: Column) -> Column:
    """Characters that inform: without markup, entities, addresses and boilerplate, white space squeezed.

    White space is a blank, tab or line end; at the ends also every other Unicode space. A letter counts as one in either case.
    """
    marked = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1>", " "), "<[^>]*>", " ")
    out = _where(_where(text, "<", marked), "&", decode_entities)
    out = _where(out, "http", lambda t: F.regexp_replace(t, r"https?://[^\t\n\f\r ]+", " "))
    out = F.lower(_where(out, "\u0130", lambda t: F.replace(t, F.lit("\u0130"), F.lit("i"))))
    for pattern in L.BOILERPLATE:
        out = _where(out, "" if "|" in re.sub(r"\(.*?\)", "", pattern) else re.match("[a-z ]*", pattern)[0], lambda t, pattern=pattern: F.regexp_replace(t, pattern, " "))
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return F.length(let(F.trim(F.regexp_replace(out, r"[\t\n\f\r ]+", " ")), lambda t: F.when(ends(t).rlike(f"[{_SPACES}]"), F.trim(t, F.lit(_SPACES))).otherwise(t)))


def token_pattern(token: str) -> str:
    """A pattern for a word in lower-case text, with an optional plural."""
    token = token.lower()
    left = "(?<![a-z0-9])" if re.match("[a-z0-9]", token) else ""
    right = "s?(?![a-z0-9])" if re.search("[a-z0-9]$", token) else ""
    return left + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", token) + right


def names_any(text: Column, tokens: list[str]) -> Column:
    """Whether lower-case text has one of the words; a text without their letters is not searched for patterns."""
    plain = [text.contains(t.lower()) for t in tokens]
    return reduce(lambda a, b: a | b, plain) & text.rlike("|".join(token_pattern(t) for t in tokens))


def haystack(*parts: Column) -> Column:
    """The parts that are not empty, in lower case, between line breaks."""
    return F.lower(F.concat_ws(" \n ", *[F.nullif(p, F.lit("")) for p in parts]))


def title_clauses(title: Column) -> Column:
    """Token lists of the clauses of a title."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+-\s+", "|")
    clauses = F.split(text, r"[/|;,&()\[\]{}•·–—]+", -1)
    return F.transform(clauses, lambda c: F.filter(F.transform(F.split(c, "[^a-z0-9.+#]+"), lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t != ""))


def contains_in_order(tokens: Column, needed: list[str]) -> Column:
    wanted = F.array(*[F.lit(x) for x in needed])
    met = F.aggregate(tokens, F.lit(0), lambda n, t: F.when(t.eqNullSafe(F.get(wanted, n)), n + 1).otherwise(n))
    return met == len(needed)


def contains_adjacent(tokens: Column, phrase: list[str]) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")


def apply_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"{START}(?=[A-Za-z0-9_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{END}", 0), F.lit(""))


def extract_address(raw: Column) -> Column:
    """The bare address in a mail header, or empty."""
    angled = F.regexp_extract_all(raw, F.lit("<([^<>]*)>"), F.lit(1))
    text = F.coalesce(F.try_element_at(angled, F.lit(-1)), raw, F.lit(""))
    token = F.coalesce(F.get(F.filter(F.split(text, r"[\s,;]+"), lambda t: t.contains("@")), F.lit(0)), F.lit(""))
    bare = F.lower(F.regexp_replace(F.regexp_replace(token, "^[\"'(<]+", ""), "[)\">'.,;]+$", ""))
    return F.when(bare.contains("@"), bare).otherwise("")


def message_id(raw: Column) -> Column:
    """A message id without white space and angles, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", ""), "^<+", ""), ">+$", ""))


def header_message_id(raw: Column) -> Column:
    own = message_id(raw)
    return F.when(own == "", "").otherwise(F.concat(F.lit("<"), own, F.lit(">")))


def normalize_email(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def split_title(raw: Column) -> Column:
    """struct(company, title): `Company: Title` where the colon is among the first 60 characters."""
    colon = F.locate(":", raw) - 1
    is_split = (colon > -1) & (colon < 60)
    company = F.when(is_split, F.trim(F.substring(raw, F.lit(1), colon)))
    return F.struct(company.alias("company"), F.when(is_split, F.trim(F.substring(raw, colon + 2, F.length(raw)))).otherwise(F.trim(raw)).alias("title"))


def job_page_id(url: Column) -> Column:
    """The number of a job page, from its path or query."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"(?i)linkedin\.com/(?:comm/)?jobs/view/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"(?i)[?&]currentJobId=(\d+)", 1), F.lit("")))


def thread_subject(subject: Column, fallback: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(subject, F.lit(""))), r"(?i)^(?:\s*re\s*:\s*)+", ""))
    return F.concat(F.lit("Re: "), F.when(bare == "", fallback).otherwise(bare))


def days_ago(days: Column) -> Column:
    n = F.floor(days + F.lit(0.5)).cast("long")
    return F.when(F.isnan(days.cast("double")) | (n < 1), None).when(n == 1, "yesterday").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))


def snippet(text: Column, size: int = 160) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(out) > size, F.concat(F.substring(out, 1, size), F.lit("…"))).otherwise(out)


def html_text(html: Column) -> Column:
    """Readable text of markup: scripts go, blocks and breaks end lines, entities are decoded, white space is squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr)>", "\n")
    out = F.replace(decode_entities(F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", "")), F.lit("\r"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t\\u00a0]+", " "), " *\\n *", "\n")
    return F.trim(F.regexp_replace(out, "^\\n+|\\n+$|(?<=\\n\\n)\\n+", ""))


def salary_text(low: Column, high: Column, currency: Column | None = None, period: Column | None = None) -> Column:
    """A range in text from bounds that may be null; null without both."""
    def money(x: Column) -> Column:
        return F.format_number(x, 0)

    text = F.when(low.isNotNull() & high.isNotNull(), F.concat(money(low), F.lit(" - "), money(high))).when(low.isNotNull(), F.concat(money(low), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("up to "), money(high)))
    return F.when(text.isNotNull(), F.concat_ws(" ", *[c for c in (currency, text, period) if c is not None]))


# Badges at the end of a card, and lines that are badges.
CARD_SEPARATOR = " · "
_COUNTED = r"\d[\d,.]*\+?\s+(?:connections?|alumni|applicants?|people)"
_AGE = r"\d+\s+(?:minutes?|hours?|days?|weeks?|months?)\s+ago"
BADGES = rf"(?i)(?:\s+(?:easy apply|actively recruiting|actively reviewing applicants|be an early applicant|fast growing|promoted|reposted|verified|viewed|new|applied on [a-z]{{3}}\s+\d{{1,2}}|\d+\s+school alum(?:ni)?|{_COUNTED}|{_AGE}))+$"
BADGE_LINE = rf"promoted|reposted|new|viewed|verified|easy apply|actively recruiting|actively reviewing applicants|be an early applicant|alumni work here|response time is typically .+|{_COUNTED}(?![A-Za-z0-9_]).*|{_AGE}|today|yesterday"


def repair_card(raw: Column) -> Column:
    """struct(title, location, easy_apply) of a card's text that was stored as a title."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")), BADGES, "")
    at = F.instr(plain, CARD_SEPARATOR)
    title = F.trim(F.when(at > 0, F.substring(plain, F.lit(1), at - 1)).otherwise(plain))
    place = F.when(at > 0, F.nullif(F.trim(F.substring(plain, at + len(CARD_SEPARATOR), F.length(plain))), F.lit("")))
    easy = F.coalesce(raw.rlike(f"(?i){START}easy apply{END}"), F.lit(False))
    return F.struct(title.alias("title"), place.alias("location"), easy.alias("easy_apply"))


def subtract_prefix(head: Column, prefix: Column) -> Column:
    """What follows the prefix, whatever the case; null if it isn't one or nothing follows."""
    h, p = F.trim(head), F.trim(prefix)
    rest = F.nullif(F.trim(F.substring(h, F.length(p) + 1, F.length(h))), F.lit(""))
    return F.when((p != "") & F.startswith(F.lower(h), F.lower(p)), rest)


def remote_of(arrangement: Column) -> Column:
    """Whether an arrangement is remote; null for an unknown one."""
    return F.nullif(arrangement, F.lit("unknown")) == "remote"
