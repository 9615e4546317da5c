"""Whole wikitext documents: sections, infoboxes, tables, references, images, links, coordinates, and their renderings.

A document is read in one pass for each construct. Templates are rendered innermost first with a stack, so that deep
nesting costs no recursion; markup that never closes stays as text. ``as_of`` fixes today's date for ages and the like.
Null texts give null. ``document`` is the column function, ``parse_document`` the same in Python.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, functions as F

# Names of namespaces and of infobox templates in several languages.
CATEGORY = "category|categoria|categoría|catégorie|kategorie|kategori|категория|تصنيف|分类"
FILE = "file|image|datei|fichier|archivo|файл"
INFOBOX = "infobox|ficha|info|карточка|bilgi kutusu|kotak info|תבנית|بطاقة|정보상자"
REDIRECT = "redirect|weiterleitung|redirection|redirección|перенаправление|تحويل|重定向"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Templates that stand for a text.
SYMBOLS = {
    "·": "·", "dot": "·", "middot": "·", "•": " • ",
    ",": ",", "=": "=", ";": ";", "colon": ":", "pipe": "|",
    "!": "|", "'": "'", "\\": " /", "`": "`",
    "[": "[", "*": "*", "asterisk": "*",
    "–": "–", "ndash": "–", "en dash": "–",
    "—": "—", "mdash": "—", "em dash": "—",
    "spd": " – ", "snds": " – ", "snd": " – ",
    "spaced ndash": " – ", "long dash": "———",
    "mdashb": "—‌", "spaced en dash": " –", "spaced en dash space": " – ",
    "1/2": "1⁄2", "1/3": "1⁄3", "2/3": "2⁄3", "1/4": "1⁄4", "3/4": "3⁄4",
    "number sign": "#", "hash-tag": "#", "no.": "#",
    "ibeam": "I", "&": "&", "ampersand": "&",
    "dagger": "†", "double-dagger": "‡",
    "^": " ", "-?": "?",
    "flat": "♭", "sharp": "♯",
    "lbf": "lbF", "lbm": "lbm",
    "tombstone": "◻", "ell": "ℓ",
    "shy": "-",
    "clear": "\n\n", "zwsp": " ", "sp": " ", "px2": " ",
    "indent": "    ", "nb5": "    ", "ns": "    ",
    "quad": "    ", "spaces": "    ", "in5": "     ",
    "thin space": " ", "thinspace": " ", "very thin space": " ",
    "word joiner": " ", "figure space": " ", "zero width joiner": " ",
    "hair space": " ", "narrow no-break space": " ", "non breaking hyphen": "-",
    "!((": "[[", "))!": "]]",
    "(": "{", "((": "{{", "(((": "{{{",
    ")": "}", "))": "}}", ")))": "}}}",
    "(!": "{|", "!+": "|+", "!-": "|-", "!)": "|}",
    "1~": "~", "2~": "~~", "3~": "~~~", "4~": "~~~~", "5~": "~~~~~",
    "goldmedal": "🥇", "silvermedal": "🥈", "bronzemedal": "🥉",
    "done": "✅", "xmark": "❌", "checked": "✔️",
    "thumbs up": "👍", "thumbs down": "👎",
    "profit": "▲",
    "minusplus": "∓", "plusminus": "±",
    "langle": "⟨", "rangle": "⟩",
    "epsilon": "ε", "xi": "𝜉", "Φ": "Φ", "phi": "𝜙", "varphi": "𝜑",
    "upsilon": "𝜐", "tau": "𝜏", "varsigma": "𝜍", "sigma": "𝜎",
    "pi": "π", "mu": "𝜇", "lambda": "𝜆", "kappa": "𝜘",
    "vartheta": "𝜗", "theta": "𝜃", "varepsilon": "𝜀", "gamma": "𝛾",
    "h.": "ḥ",
}

# Templates that give back one of their parameters, by its place.
PLACED = {
    "p1": 0, "p2": 1, "p3": 2,
    "resize": 1, "lang": 1, "rtl-lang": 1,
    "line-height": 1, "l": 2, "h": 1,
    "sort": 1, "color": 1, "background color": 1,
}

# Templates that give back their first parameter.
FIRST = (
    "defn", "lino", "finedetail", "nobold", "noitalic", "nocaps",
    "vanchor", "rnd", "date", "taste", "monthname",
    "baseball secondary style", "nowrap", "nobr",
    "big", "cquote", "pull quote", "smaller", "midsize", "larger",
    "kbd", "bigger", "large", "mono", "strongbad", "stronggood", "huge",
    "xt", "xt2", "!xt", "xtn", "xtd", "dc", "dcr",
    "mxt", "!mxt", "mxtn", "mxtd", "bxt", "!bxt", "bxtn", "bxtd",
    "delink", "pre", "var", "mvar", "pre2", "code", "char",
    "angle bracket", "symb", "dabsearch", "key press",
    "nowiki", "nowiki2", "unstrip", "unstripnowiki",
    "plain text", "make code", "killmarkers",
    "longitem", "longlink", "strikethrough", "underline", "uuline",
    "not a typo", "text", "var serif", "double underline",
    "nee", "ne", "left", "right", "center", "centered", "justify",
    "smalldiv", "bold div", "monodiv", "italic div", "bigdiv",
    "strikethroughdiv", "strikethrough color",
    "pbpe", "video game release/abbr", "nobel abbr",
    "gloss", "gcl", "overline", "overarc", "normal", "norm",
    "tmath", "vec", "subst", "highlight", "tq",
    "subst:nft", "subst:nwft", "subst:nfa",
)

# Cells of tables with a text of their own.
CELL_TEXTS = {
    "active fire": "Active", "site active": "Active",
    "site inactive": "Inactive", "yes2": "", "no2": "",
    "ya": "✅", "na": "❌", "nom": "Nominated",
    "sho": "Shortlisted", "tba": "TBA", "maybecheck": "✔️",
    "okay": "Neutral", "n/a": "N/A", "sdash": "—",
    "dunno": "?", "draw": "", "cnone": "", "nocontest": "",
}

# Templates that stand for their name.
PRONOUNS = (
    "they", "them", "their", "theirs", "themself",
    "they are", "they were", "they have", "they do",
    "he or she", "him or her", "his or her", "his or hers",
    "he/she", "him/her", "his/her",
)

#: The tables together, and a few more that give back a parameter.
GIVEN = PLACED | dict.fromkeys((*FIRST, "small", "abbr", "literal"), 0) | dict.fromkeys(("font color", "colored link"), 1)

# Signs of currencies.
CURRENCY = {"£": "GB£", "€": "€", "¥": "¥", "₹": "₹", "usd": "US$", "us$": "US$", "gbp": "GB£", "eur": "€", "jpy": "¥", "cny": "CN¥", "inr": "₹", "rub": "₽", "aud": "A$", "cad": "CA$", "chf": "CHF", "krw": "₩"}
# Abbreviations that don't end a sentence.
SENTENCE_ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "esp", "eg", "ie", "inc", "ltd", "co", "corp", "st", "mt", "ft", "gen", "gov",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "no", "vol", "pp", "ca",
)
# Fields of citations.
CITATION_FIELDS = ("title", "url", "publisher", "work", "newspaper", "journal", "website", "encyclopedia")


class Template:
    """``{{name|positional|key=value}}``; ``get`` takes the first parameter that is there and not empty."""

    def __init__(self, body: str):
        name, *parts = split_bars(body)
        self.name = re.sub(r"[\s_]+", " ", name).strip()
        self.low, self.list, self.named = self.name.lower(), [], {}
        for p in parts:
            key, eq, value = p.partition("=")
            if eq and re.fullmatch(r"[\w \-.]+", key.strip()):
                self.named[key.strip()] = value.strip()
            else:
                self.list.append(p.strip())

    def get(self, *keys: str | int) -> str:
        for k in keys:
            value = self.named.get(str(k), "") or (self.list[k - 1] if isinstance(k, int) and 0 < k <= len(self.list) else "")
            if value:
                return value
        return ""

    def number(self, k: int, default: float = 0.0) -> float:
        try:
            value = float(self.get(k).replace(",", ""))
            return value if math.isfinite(value) else default
        except ValueError:
            return default


def split_bars(body: str) -> list[str]:
    """At bars outside links and templates."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\[\[|\]\]|\{\{|\}\}|\|", body):
        if m[0] == "|":
            if depth <= 0:
                out.append(body[at : m.start()])
                at = m.end()
        else:
            depth += 1 if m[0] in ("[[", "{{") else -1
    return [*out, body[at:]]


def shown(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def day_of(t: Template, first: int = 1) -> str:
    y, m, d = t.get("year", first), t.get("month", first + 1), t.get("day", first + 2)
    month = MONTHS[int(m) - 1] if m.isdecimal() and 1 <= int(m) <= 12 else m
    return f"{month} {d}, {y}" if y and m and d else f"{month} {y}" if y and m else y


def as_date(t: Template, first: int, today: date) -> date:
    try:
        return date(int(t.number(first)), int(t.number(first + 1, 1)), int(t.number(first + 2, 1)))
    except ValueError:
        return today


def age_parts(a: date, b: date) -> tuple[int, int, int]:
    """Years, months and days; a borrowed month has 30 days."""
    y, m, d = b.year - a.year, b.month - a.month, b.day - a.day
    if d < 0:
        m, d = m - 1, d + 30
    if m < 0:
        y, m = y - 1, m + 12
    return y, m, d


def coordinates(t: Template) -> tuple[float, float] | None:
    """Signed degrees from 2, 4, 6 or 8 positional parts."""
    parts = []
    for p in t.list:
        if re.fullmatch(r"[+-]?\d+(\.\d+)?", p) or p.upper() in ("N", "S", "E", "W"):
            parts.append(p.upper())
        else:
            break
    half = len(parts) // 2
    if len(parts) not in (2, 4, 6, 8):
        return None

    def degrees(xs: list[str]) -> float:
        sign = -1 if xs[-1] in ("S", "W") else 1
        return sign * sum(float(x) / 60**i for i, x in enumerate(v for v in xs if v not in "NSEW"))

    try:
        lat, lon = degrees(parts[:half]), degrees(parts[half:])
    except ValueError:
        return None
    return (round(lat, 5), round(lon, 5)) if abs(lat) <= 90 and abs(lon) <= 360 else None


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def convert(t: Template) -> str:
    return f"{t.get(1)} {t.get(2)} {t.get(3)}" if t.get(2) in ("-", "to", "and") else f"{t.get(1)} {t.get(2)}"


def sortname(t: Template) -> str:
    name = f"{t.get('first', 1)} {t.get('last', 2)}".strip()
    target = t.get("target", 3) or name
    if t.get("nolink"):
        return name
    return f"[[{target} ({t.get('dab')})|{name}]]" if t.get("dab") else f"[[{name}]]" if target == name else f"[[{target}|{name}]]"


def domain(t: Template) -> str:
    return t.get(2) or re.sub(r"/.*$", "", re.sub(r"^(https?://)?(www\.)?", "", t.get(1))) or t.get(1)


def as_of_text(t: Template) -> str:
    start = "" if t.get("bare") else "Since " if t.get("since") else "As of "
    return (start.lower() if t.get("lc") else start) + day_of(t)


def value_text(t: Template) -> str:
    n = t.number(1, math.nan)
    text = t.get(1) if math.isnan(n) or not n else f"{n:,.10g}" if n != int(n) else f"{int(n):,}"
    unit = t.get("u", "ul", "upl")
    return t.get("p") + text + t.get("s") + (f" {unit}" if unit else "")


def rounded(x: float, places: int = 0) -> float:
    return math.floor(x * 10**places + 0.5) / 10**places


RENDER: dict[str, Callable[[Template, date], str]] = {}


def template(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        RENDER.update(dict.fromkeys(names, f))
        return f

    return add


template("birth date and age", "bda", "birth date", "death date and age", "death date", "start date", "end date", "start", "end", "start date and age", "end date and age")(lambda t, _: day_of(t))
template("as of")(lambda t, _: as_of_text(t))
template("age", "age nts")(lambda t, now: str(age_parts(as_date(t, 1, now), as_date(t, 4, now))[0]))
template("age in years", "diff-y")(lambda t, now: f"{age_parts(as_date(t, 1, now), as_date(t, 4, now))[0]} years")
template("age in years and months", "diff-ym")(lambda t, now: "{} years, {} months".format(*age_parts(as_date(t, 1, now), as_date(t, 4, now))))
template("age in years, months and days", "diff-ymd")(lambda t, now: "{} years, {} months, {} days".format(*age_parts(as_date(t, 1, now), as_date(t, 4, now))))
template("birth year and age")(lambda t, now: f"{t.get(1)} (age {now.year - int(t.number(1, now.year))})")
template("death year and age")(lambda t, _: f"{t.get(1)} (age {int(t.number(1) - t.number(2))})")
template("reign", "r.")(lambda t, _: f"(r. {t.get(1)} – {t.get(2)})")
template("currentyear", "localyear")(lambda _, now: str(now.year))
template("currentmonth", "currentmonthname", "localmonth")(lambda _, now: MONTHS[now.month - 1])
template("currentday", "localday")(lambda _, now: str(now.day))
template("monthyear")(lambda _, now: f"{MONTHS[now.month - 1]} {now.year}")
template("convert", "cvt")(lambda t, _: convert(t))
template("fraction", "frac", "sfrac")(lambda t, _: f"{t.get(1)} {t.get(2)}/{t.get(3)}" if t.get(3) else f"{t.get(1)}/{t.get(2)}" if t.get(2) else f"1/{t.get(1)}")
template("val")(lambda t, _: value_text(t))
template("sortname")(lambda t, _: sortname(t))
template("hlist", "flatlist", "plainlist", "ubl", "unbulleted list", "cslist", "comma separated entries")(lambda t, _: ", ".join(x for x in t.list if x))
template("bulleted list")(lambda t, _: "\n\n".join(f"• {x}" for x in t.list if x))
template("br separated entries")(lambda t, _: "\n\n".join(x for x in t.list if x))
template("url", "official website", "official")(lambda t, _: domain(t))
template("marriage")(lambda t, _: t.get("spouse", 1) + (f" (m. {t.get(2)}" + (f"–{t.get(3)}" if t.get(3) else "") + ")" if t.get(2) else ""))
template("first word")(lambda t, _: t.get(1).split(t.get("sep") or " ")[0])
template("last word")(lambda t, _: t.get(1).split(t.get("sep") or " ")[-1])
template("trunc", "str left")(lambda t, _: t.get(1)[: int(t.number(2))])
template("replace")(lambda t, _: t.get(1).replace(t.get(2), t.get(3)) if t.get(2) else t.get(1))
template("lc", "lcase")(lambda t, _: t.get(1).lower())
template("uc", "ucase")(lambda t, _: t.get(1).upper())
template("ucfirst")(lambda t, _: t.get(1)[:1].upper() + t.get(1)[1:])
template("lcfirst")(lambda t, _: t.get(1)[:1].lower() + t.get(1)[1:])
template("title case")(lambda t, _: " ".join(w[:1].upper() + w[1:] for w in t.get(1).split(" ")))
template("decade")(lambda t, _: f"{int(t.number(1)) // 10 * 10}s")
template("century")(lambda t, _: str(int(t.number(1)) // 100 + 1))
template("millennium")(lambda t, _: str(int(t.number(1)) // 1000 + 1))
template("percentage", "percent", "pct")(lambda t, _: f"{shown(rounded(100 * t.number(1) / t.number(2), int(t.number(3, 1))))}%" if t.number(2) else "")
template("plural")(lambda t, _: f"{t.get(1)} {t.get(2) if t.number(1) == 1 else t.get(3) or t.get(2) + 's'}")
template("min")(lambda t, _: shown(min(t.number(i + 1) for i in range(len(t.list)))) if t.list else "")
template("max")(lambda t, _: shown(max(t.number(i + 1) for i in range(len(t.list)))) if t.list else "")
template("round")(lambda t, _: shown(rounded(t.number(1), int(t.number(2)))))
template("formatnum")(lambda t, _: f"{int(t.number(1)):,}" if t.number(1) == int(t.number(1)) else f"{t.number(1):,}")
template("hexadecimal")(lambda t, _: f"{int(t.number(1)):X}")
template("hex2dec")(lambda t, _: str(int(t.get(1), 16)) if re.fullmatch("[0-9a-fA-F]+", t.get(1)) else "")
template("ordinal", "ord")(lambda t, _: ordinal(int(t.number(1))))
template("circa")(lambda t, _: f"c. {t.get(1)}")
template("tl")(lambda t, _: t.get(1))
template("radic")(lambda t, _: f"{t.get(2)}√{t.get(1)}")
template("nihongo")(lambda t, _: t.get(1) + (f" ({', '.join(x for x in (t.get(2), t.get(3)) if x)})" if t.get(2) or t.get(3) else ""))


class Reader:
    def __init__(self, title: str | None, text: str, as_of: date):
        self.as_of, self.templates, self.boxes, self.coords, self.references, self.named, self.images = as_of, [], [], [], [], {}, []
        text = re.sub(r"__[A-Z]{3,}__", "", re.sub(r"<!--.*?-->", "", text, flags=re.S))
        m = re.match(rf"\s*#(?:{REDIRECT})\s*:?\s*\[\[([^\]|#]+)", text, re.I)
        self.redirect = m[1].strip() if m else None
        text = self.rendered(self.without_references(text))
        self.categories = list(dict.fromkeys(m.strip() for m in re.findall(rf"\[\[\s*(?:{CATEGORY})\s*:\s*([^\]|\[]+)", text, re.I)))
        text = re.sub(rf"\[\[\s*(?:{CATEGORY})\s*:[^\]\[]*\]\]\n?", "", text, flags=re.I)
        text = self.without_images(text)
        bold = re.search(r"'''([^'\n]+)'''", text)
        self.title = title or (bold[1] if bold else None)
        self.tables, text = tables_of(text)
        self.links = links_of(text)
        self.sections = self.split_sections(text)

    def rendered(self, text: str) -> str:
        """Every template in place of which a text stands; one stack of open ones, inner ones first."""
        stack: list[list[str]] = [[]]
        for part in re.split(r"(\{\{|\}\})", text):
            if part == "{{":
                stack.append([])
            elif part == "}}" and len(stack) > 1:
                body = "".join(stack.pop())
                stack[-1].append(self.render(Template(body)))
            else:
                stack[-1].append(part)
        for body in stack[1:]:  # never closed: it stays as it is
            body.insert(0, "{{")
        return "".join(x for body in stack for x in body)

    def render(self, t: Template) -> str:
        if re.match(rf"(?:{INFOBOX})\b", t.low) or t.low.endswith(" infobox") or t.low in ("taxobox", "speciesbox"):
            kind = re.sub(rf"^(?:{INFOBOX})\s*|\s*infobox$", "", t.low).strip()
            self.boxes.append({"type": kind, "data": {k: plain(v) for k, v in t.named.items()}})
            return ""
        self.templates.append(t.low)
        if t.low == "coord" or t.low.startswith("coor "):
            found = coordinates(t)
            if found:
                self.coords.append(found)
                display = t.get("display") or "inline"
                lat, lon = found
                return f"{abs(lat)}°{'S' if lat < 0 else 'N'}, {abs(lon)}°{'W' if lon < 0 else 'E'}" if "inline" in display else ""
        if t.low in SYMBOLS and not t.list:
            return SYMBOLS[t.low]
        if t.low in CURRENCY:
            return CURRENCY[t.low] + t.get(1)
        if t.low in RENDER:
            return RENDER[t.low](t, self.as_of)
        place = GIVEN.get(t.low)
        if place is not None and place < len(t.list):
            return t.list[place]
        if t.low in CELL_TEXTS:
            return t.list[0] if t.list else CELL_TEXTS[t.low]
        return t.low if t.low in PRONOUNS else SYMBOLS.get(t.low, "")

    def without_references(self, text: str) -> str:
        """In the order of the text; a reuse takes the definition wherever it stands."""
        found = []

        def note(m: re.Match) -> str:
            name = re.search(r"""name\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s/>]+))""", m[1])
            name = next((g for g in name.groups() if g), None) if name else None
            body = None if m[2] is None else self.citation(m[2])
            if name and body:
                self.named.setdefault(name, body)
            if body or name:
                found.append((name, body))
            return " "

        # an opening tag's end is searched on from the tag, not past the next reference
        text = re.sub(r"<ref\b([^<>]*?)(?:/>|>((?:(?!<ref\b)[^<]|<(?!/?ref\b))*)</ref\s*>)", note, text, flags=re.I)
        self.references = [(body or self.named.get(name) or {"type": "reuse"}) | ({"name": name} if name else {}) for name, body in found]
        return text

    def citation(self, body: str) -> dict:
        m = re.search(r"\{\{\s*(cite |citation)", body, re.I)
        if not m:
            return {"type": "inline", "inline": plain(body).strip()}
        end = body.rfind("}}")
        t = Template(body[m.start() + 2 : end if end > m.start() else len(body)])
        out = {"type": re.sub("^cite ", "", t.low).replace("citation", "general")} | {f: plain(t.get(f)) for f in CITATION_FIELDS if t.get(f)}
        author, first = t.get("author", "last", "author1", "last1"), t.get("first", "first1")
        if author:
            out["author"] = f"{author}, {first}" if first else author
        if t.get("date", "year"):
            out["date"] = t.get("date", "year")
        if t.get("access-date", "accessdate"):
            out["access_date"] = t.get("access-date", "accessdate")
        return out

    def without_images(self, text: str) -> str:
        """Files, whose captions may hold links."""
        ends, opened = {}, []
        for b in re.finditer(r"\[\[|\]\]", text):
            if b[0] == "[[":
                opened.append(b.start())
            elif opened:
                ends[opened.pop()] = b.end()
        out, at = [], 0
        for m in re.finditer(rf"\[\[\s*(?:{FILE})\s*:", text, re.I):
            end = ends.get(m.start())
            if m.start() < at or end is None:
                continue
            out.append(text[at : m.start()])
            self.images.append(image_of(text[m.end() : end - 2]))
            at = end
        return "".join([*out, text[at:]])

    def split_sections(self, text: str) -> list[dict]:
        heads = list(re.finditer(r"(?m)^(={2,6})[ \t]*([^\n]*?)[ \t]*\1[ \t]*$", text))
        ends = [h.start() for h in heads] + [len(text)]
        out = [{"title": "", "depth": 0, "text": paragraphs(text[: ends[0]])}]
        for h, end in zip(heads, ends[1:], strict=True):
            body, title = paragraphs(text[h.end() : end]), plain(h[2])
            if not (not body and re.fullmatch("(?i)references|notes|citations|sources", title)):
                out.append({"title": title, "depth": len(h[1]) - 2, "text": body})
        return out


def image_of(inner: str) -> dict:
    name, *params = [p.strip() for p in split_bars(inner)]
    out = {"file": name}
    for p in params:
        key, eq, value = p.partition("=")
        if eq and key.strip().lower() in ("alt", "link", "class", "lang", "page", "upright", "thumb"):
            out[key.strip().lower()] = value.strip()
        elif re.fullmatch(r"(\d+)?(x\d+)?px", p):
            out["size"] = p
        elif p in ("left", "right", "center", "none"):
            out["align"] = p
        elif p in ("thumb", "thumbnail", "frame", "framed", "frameless", "border"):
            out["format"] = p
        elif p:
            out["caption"] = plain(p)
    return out


def plain(text: str) -> str:
    """Links as their text, no emphasis, no tags, entities as characters."""
    text = re.sub(r"\[\[([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,5}", "", re.sub(r"<br\s*/?>", "\n", text, flags=re.I))
    return html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", text)).strip()


def paragraphs(text: str) -> str:
    lines = [re.sub(r"^[*#:;]+\s*", lambda m: "• " if "*" in m[0] or "#" in m[0] else "", x) for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", plain("\n".join(lines)))


def links_of(text: str) -> list[dict]:
    """Internal links (page, anchor, text with the letters glued to it) and external ones (url, text)."""
    out = []
    for m in re.finditer(r"\[\[([^\[\]|#]*)(?:#([^\[\]|]*))?(?:\|([^\[\]]*))?\]\](\w*)|\[((?:https?:)?//[^\s\]]+)\s*([^\]]*)\]", text):
        page, anchor, shown_, glued, url, label = m.groups()
        if url:
            out.append({"type": "external", "url": url, "text": label})
        elif (page or anchor) and not re.match(r"\s*:?\s*[a-z ]{2,15}:(?!\s)", page, re.I):
            page = page.strip()
            out.append({"type": "internal", "page": page, "anchor": anchor, "text": (shown_ if shown_ is not None else page) + glued})
    return out


def tables_of(text: str) -> tuple[list[list[dict]], str]:
    """Tables as lists of rows by column names, inner ones first; and the text without them."""
    stack, found, rest = [], [], []
    for line in text.split("\n"):
        if re.match(r"\s*\{\|", line):
            stack.append([])
        elif stack and re.match(r"\s*\|\}", line):
            found.append(rows_of(stack.pop()))
        else:
            (stack[-1] if stack else rest).append(line)
    while stack:  # never closed
        rest += stack.pop(0)
    return [t for t in found if t], "\n".join(rest)


def rows_of(lines: list[str]) -> list[dict]:
    raw: list[list[tuple[bool, str, str]]] = [[]]
    for line in lines:
        s = line.strip()
        if s.startswith("|+"):
            continue
        if s.startswith("|-"):
            raw.append([])
        elif s[:1] in ("|", "!"):
            head = s[0] == "!"
            for cell in re.split(r"\|\||!!" if head else r"\|\|", s[1:]):
                style, *value = split_bars(cell)
                raw[-1].append((head, "|".join(value) if value else style, style if value else ""))
        elif raw[-1] and s:
            head, value, style = raw[-1][-1]
            raw[-1][-1] = (head, f"{value}\n{line}", style)
    grid: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}  # columns that a cell above still covers
    heads: list[bool] = []
    for cells in filter(None, raw):
        row: list[str] = []

        def covered() -> None:
            while len(row) in below:
                left, value = below.pop(len(row))
                if left > 1:
                    later[len(row)] = (left - 1, value)
                row.append(value)

        later: dict[int, tuple[int, str]] = {}
        for _, value, style in cells:
            covered()
            span = lambda what: min(100, int(m[1])) if (m := re.search(rf"""{what}\s*=\s*["']?(\d+)""", style, re.I)) else 1  # noqa: E731, B023
            for _ in range(max(1, span("colspan"))):
                if span("rowspan") > 1:
                    later[len(row)] = (span("rowspan") - 1, plain(value))
                row.append(plain(value))
        covered()
        below = {**below, **later}
        grid.append(row)
        heads.append(all(h for h, *_ in cells))
    if not grid:
        return []
    names = grid.pop(0) if heads[0] and len(grid) > 1 else []
    name = lambda i: (names[i] if i < len(names) else "") or f"col{i + 1}"
    return [{name(i): v for i, v in enumerate(row)} for row in grid]


def sentences(text: str, most: int | None = None) -> list[str]:
    """Split after ``.!?`` before white space; abbreviations and single letters do not end one."""
    out, at = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|$)", text):
        word = re.search(r"([\w.]+)$", text[max(at, m.start() - 20) : m.start()])
        if m[0] == "." and word and (word[1].lower() in SENTENCE_ABBREVIATIONS or re.fullmatch(r"(?:\w\.)*\w", word[1])):
            continue
        piece = text[at : m.end()].strip()
        at = m.end()
        if piece:
            out.append(piece)
        if most and len(out) >= most:
            return out
    return out + ([text[at:].strip()] if text[at:].strip() else [])


def summary(text: str, most: int = 3, size: int = 4096) -> str:
    return " ".join(sentences(text[:size], most))


def is_disambiguation(title: str | None, reader: Reader) -> bool:
    named = bool(re.search(r"\(disambiguation\)\s*$", title or "", re.I))
    marked = any(re.match(r"disambig|disamb$|dab$|hndis$|geodis$|surname$", n) for n in reader.templates)
    return named or marked or bool(re.search(r"may (also )?refer to:", reader.sections[0]["text"], re.I))


def parse_document(title: str | None, text: str, as_of: date) -> dict:
    r = Reader(title, text, as_of)
    return {
        "title": r.title, "redirect": r.redirect, "disambiguation": is_disambiguation(title, r), "summary": summary(r.sections[0]["text"]),
        "categories": r.categories, "sections": r.sections, "infoboxes": r.boxes, "tables": r.tables,
        "references": [{k: str(v) for k, v in x.items()} for x in r.references], "images": r.images, "links": r.links,
        "coordinates": [{"lat": a, "lon": b} for a, b in r.coords], "templates": r.templates,
    }


def markdown(doc: dict) -> str:
    out = [f"# {(doc['title'] or 'Untitled').replace('_', ' ')}", ""]
    if doc["summary"]:
        out += [doc["summary"], ""]
    if doc["infoboxes"]:
        box = doc["infoboxes"][0]
        out += [f"## {box['type']}", "", "| Field | Value |", "|-------|-------|"]
        out += [f"| {k.replace('_', ' ')} | {v} |" for k, v in box["data"].items() if len(v) < 100] + [""]
    for s in doc["sections"]:
        if s["title"]:
            out += ["#" * min(s["depth"] + 2, 6) + f" {s['title']}", ""] + ([s["text"][:2000], ""] if s["text"] else [])
    return "\n".join(out)


def full_json(doc: dict) -> str:
    """The document with its sections cut at 2000 characters, 100 links and 50 templates."""
    cut = doc | {"sections": [s | {"text": s["text"][:2000]} for s in doc["sections"]], "links": doc["links"][:100], "templates": doc["templates"][:50]}
    return json.dumps(cut, ensure_ascii=False)


SCHEMA = (
    "title string, redirect string, disambiguation boolean, summary string, categories array<string>, sections array<struct<title string, depth int, text string>>, "
    "infoboxes array<struct<type string, data map<string, string>>>, tables array<array<map<string, string>>>, references array<map<string, string>>, images array<map<string, string>>, "
    "links array<struct<type string, page string, anchor string, url string, text string>>, coordinates array<struct<lat double, lon double>>, templates array<string>, markdown string, json string"
)


def document(title: Column, text: Column, as_of: date) -> Column:
    """A struct of SCHEMA; the markdown and JSON forms with it. Null texts give null."""

    @F.udf(SCHEMA, useArrow=True)
    def run(t: str | None, s: str | None) -> dict | None:
        if s is None:
            return None
        doc = parse_document(t, s, as_of)
        fields = ("type", "page", "anchor", "url", "text")
        return doc | {"links": [{k: x.get(k) for k in fields} for x in doc["links"]], "markdown": markdown(doc), "json": full_json(doc)}

    return run(title, text)


def infobox_field(data: Column, name: str) -> Column:
    """A value by its key, whatever its case, dashes or underscores."""
    key = lambda c: F.lower(F.regexp_replace(c, "[-_]", " "))
    return F.map_values(F.map_filter(data, lambda k, _: key(k) == F.lit(re.sub("[-_]", " ", name.lower()))))[0]


def infobox_of(boxes: Column, kind: str) -> Column:
    """The data of the first infobox whose type holds ``kind``."""
    return F.get(F.filter(boxes, lambda b: F.contains(F.lower(b["type"]), F.lit(kind.lower()))), 0)["data"]


