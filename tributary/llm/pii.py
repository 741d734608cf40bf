"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Every kind has a keyed permutation of its own domain (``permutation``), applied to a canonical form without layout. So
equal originals get equal surrogates in all documents, however they are written (coreference), and different originals
different ones, with no table of originals to build, ship or keep. The original's layout is put back afterwards:

* e-mail addresses: letters and digits change, separators, case, length and the last label of the host stay;
  hosts reserved for examples stay whole;
* account numbers (IBAN): country, grouping and places of letters stay; check digits are right where they were;
* payment cards (digits with a right check digit) keep their first digit, their grouping and a right check digit;
* phone numbers keep country code, trunk zero and layout; a North American number is one with and without its code;
* IPv4 addresses stay in their private, loopback or public range;
* listed first names become another of the same list (gender and script), or a double name of the title's gender if
  the title contradicts the list; other names keep script, length and shape, vowels for vowels and consonants for
  consonants, first names also whether they end in the letter of feminine names; no surrogate is a listed name
  unless the original is. Each name of a person met in a document is followed where it stands alone there.

Names are found by what stands around them: a title, a listed first name, a phrase that introduces or follows people,
or a contact (e-mail, phone, number) within ``NEAR`` characters on the line; the rest is shape (two capitalised words,
initials and particles between them). See the README for what isn't found.

Collision check: all pairs of canonical form and surrogate are aggregated over the corpus; an original whose surrogate
another one has gets the next permutation, until no surrogate is shared (``surrogates`` and ``redact`` both do this).

Time is linear in the text. Null texts stay null and have no entities, texts without entities stay as they are,
overlapping candidates are resolved leftmost, longest, then by the order of ``KINDS``. Repeated rows are treated
alike; an empty table gives an empty result; other columns, whatever their names, pass through ``redact`` untouched.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns, map_values
from tributary.llm.permutation import permute, permute_digits

KEY = b"tributary"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "name")
NEAR = 40

#: Scripts with capitals in which names are looked for: Latin, Greek, Cyrillic, Armenian.
CASED = [(0x0041, 0x058F), (0x1C80, 0x1C8F), (0x1E00, 0x1FFF)]
#: Fixed lists: titles by gender (n: either), first names by gender and script, words around names.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n"}
FIRST = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Charlotte Clara Diana Elena Elisabeth Emily Emma Eva Fiona Hannah Helen Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monica Nancy Natalie Nina Olivia Patricia Petra Rachel Rosa Sandra Sarah Sofia Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Alexander Andreas Anthony Arthur Carlos Charles Christian Daniel David Diego Edward Felix Francis Frank Fernando George Hans Henry Hugo James Jean Jorge Joseph John Juan Karl Klaus Louis Luis Marco Mark Martin Michael Miguel Nicolas Oliver Oscar Paul Pedro Peter Philip Pierre Richard Robert Stefan Thomas Victor William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Максим Михаил Николай Олег Павел Сергей Юрий".split(),
}
PARTICLES = set("van von de der den del della da di du la le bin al ten ter zu".split())
NOT_NAMES = set("The A An In On At Of And Or For With From To By This That These Those My Our Your His Her Their I We You He She It They Dear Hello Hi Contact Call Mail Email Phone Tel Fax Name Please Thanks Regards Sincerely Signed Author New North South East West United Saint University Inc Ltd Company Street Road Avenue Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())
BEFORE = re.compile(r"(?:\bname(?: is|'s|:)|\bnamed|\bcalled|\bdear|\bcontact|\battn[.:]?|\bi am|\bi'm|\bsigned(?: by)?|\bregards,|\bsincerely,|\bauthor:|\bfrom:|\bto:|\bcc:|\bwritten by|\bemployee|\bcustomer|\bpatient|\bwitness|\bheiße|\bich bin|\bme llamo|\bm['’]appelle|\bменя зовут):?\s+$", re.I)
AFTER = re.compile(r",?\s(?:said|says|wrote|writes|asked|replied|told|called|lives|works|was born|sagte|schrieb|dijo|escribió|a dit|сказал|сказала)\b")
LISTED = {name: group for group, names in FIRST.items() for name in names}
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñßýÿ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ",
           "āăąēĕėęěĩīĭįōŏőœũūŭůűų", "ćĉċčďđĝğġģĥħĵķĺļľŀłńņňŋŕŗřśŝşšţťŧŵŷźżžșț", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "ёіїєѐѝў", "ґђѓјљњћќџ", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ")
CLASS_OF = {c: k for k, cs in enumerate(CLASSES) for c in cs}
#: Last letters of first names, and what they become: endings of feminine names stay.
FEMININE = {c: group for group in ("a", "eiou", "а", "я", "еиоуыэю") for c in group}
DOUBLED = str.maketrans("0123456789", "0246813579")  # twice a digit, its digits added
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
RESERVED = re.compile(r"(^|\.)(example\.(com|net|org)|invalid|test|localhost)$")
#: Country codes of fewer than three digits (fixed values); all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: IPv4 ranges that stay what they are (fixed values): first address and bits within.
RANGES = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24))


def _token() -> re.Pattern:
    """A capitalised word; capitals, apostrophes and hyphens may stand within."""
    points = [chr(p) for lo, hi in CASED for p in range(lo, hi + 1)]
    upper = "[" + "".join(c for c in points if c.isupper() or c.istitle()) + "]"
    return re.compile(rf"(?<!\w){upper}[^\W\d_]*+(?:['’-]{upper}[^\W\d_]*+)*+(?!\w)")


TOKEN = _token()
PATTERNS = {
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "card": re.compile(r"(?<![\w.+-])\d++(?:[ -]\d++)*+"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"),
}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    gender: str = "n"  # of a name, by its title


# surrogates


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text


def reshape(text: str, key: bytes, tweak: str, alphabets) -> str:
    """Permute lower-case letters and digits over one alphabet for each place (``alphabets(i, c)``; None: the character stays)."""
    places = [(i, a) for i, c in enumerate(text) if (a := alphabets(i, c)) and c in a]
    if all(len(a) == 1 for _, a in places):
        return text
    out = list(text)
    for i, _ in places:
        out[i] = "\0"
    tweak = f"{tweak}|{''.join(out)}|{','.join(a[0] + str(len(a)) for _, a in places)}"
    for (i, a), d in zip(places, permute_digits([a.index(text[i]) for i, a in places], [len(a) for _, a in places], key, tweak), strict=True):
        out[i] = a[d]
    return "".join(out)


def _cased(new: str, layout: str) -> str:
    """``new`` with capitals where ``layout`` has them."""
    return "".join(o.upper() if c.isupper() and len(o.upper()) == 1 else o for o, c in zip(new, layout, strict=True))


def _alnum(i: int, c: str) -> str | None:
    return LETTERS if c in LETTERS else DIGITS if c in DIGITS else None


def _upper_alnum(i: int, c: str) -> str | None:
    return LETTERS.upper() if c.isalpha() else DIGITS


def _shaped(i: int, c: str) -> str | None:
    return CLASSES[CLASS_OF[c]] if c in CLASS_OF else None


def luhn(digits: str) -> int:
    """Check digit that ``digits`` should be followed by."""
    return -(sum(map(int, digits[-2::-2])) + sum(map(int, digits[::-2].translate(DOUBLED)))) % 10


def iban_check(country: str, rest: str) -> int:
    """Check digits of an account number."""
    number = "".join(str(int(c, 36)) for c in rest + country) + "00"
    return 98 - int(number) % 97


def _spread(new: str, layout: str, place) -> str:
    """The characters of ``new`` where ``place(c)`` holds in ``layout``."""
    it = iter(new)
    return "".join(next(it) if place(c) else c for c in layout)


def canonical(kind: str, original: str) -> str:
    """An entity without its layout: what two spellings of one entity share."""
    if kind == "email":
        return original.lower()
    if kind == "iban":
        return original.replace(" ", "")
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", original)
    if kind == "ip":
        return ".".join(str(int(x)) for x in original.split("."))
    if kind == "phone":
        digits = re.sub(r"\D", "", original.replace("(0)", "") if original.startswith("+") else original)
        return digits if original.startswith("+") else "1" + digits
    return _lower(original)


def country_code(digits: str) -> str:
    """The country code that international digits begin with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])


def _phone_places(code: str):
    def alphabet(i: int, c: str) -> str:
        if code == "1" and i in (0, 3):  # area and exchange
            return "01" if c in "01" else "23456789"
        return ("0" if c == "0" else DIGITS[1:]) if i == 0 else DIGITS

    return alphabet


def _ip(x: int, key: bytes, tweak: str) -> int:
    for base, bits in RANGES:
        if x >> bits == base >> bits:
            return base | permute(x & (1 << bits) - 1, 1 << bits, key, f"{tweak}|{base}")
    y = permute(x, 1 << 32, key, tweak)
    while any(y >> bits == base >> bits for base, bits in RANGES):
        y = permute(y, 1 << 32, key, tweak)
    return y


def _first_name(name: str, gender: str, key: bytes, tweak: str) -> str:
    """One part of a first name."""
    if name in LISTED:
        own, script = LISTED[name]
        names = FIRST[own, script]
        if gender in ("n", own):
            return names[permute(names.index(name), len(names), key, f"{tweak}|{own}|{script}")]
        other = FIRST[gender, script]  # the title says otherwise: a double name of its gender
        x = permute(names.index(name), len(other) * (len(other) - 1), key, f"{tweak}|{own}|{gender}|{script}")
        i, j = divmod(x, len(other) - 1)
        return f"{other[i]}-{other[j + (j >= i)]}"
    low = _lower(name)

    def place(i: int, c: str) -> str | None:
        return FEMININE.get(c) or _shaped(i, c) if i == len(low) - 1 else _shaped(i, c)

    new = reshape(low, key, tweak, place)
    while (out := _cased(new, name)) in LISTED:  # the next of the cycle, which is no listed name's
        new = reshape(new, key, tweak, place)
    return out


def surrogate(kind: str, original: str, key: bytes = KEY, gender: str = "n", salt: int = 0) -> str:
    """The replacement of one entity (``first`` and ``last`` are parts of names); ``salt`` counts permutations given up."""
    tweak = f"{kind}|{salt}" if salt else kind
    plain = canonical(kind, original)
    if kind == "email":
        local, _, host = plain.rpartition("@")
        new = reshape(local, key, f"{tweak}|{host}", _alnum)
        if not RESERVED.search(host):
            labels, _, top = host.rpartition(".")
            host = f"{reshape(labels, key, f'host|{salt}', _alnum)}.{top}"
        return _cased(f"{new}@{host}", original)
    if kind == "card":
        body = plain[0] + reshape(plain[1:-1], key, f"{tweak}|{plain[0]}", _alnum)
        return _spread(body + str(luhn(body)), original, str.isdigit)
    if kind == "ip":
        a, b, c, d = map(int, plain.split("."))
        y = _ip((a << 24) | (b << 16) | (c << 8) | d, key, tweak)
        return f"{y >> 24}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"
    if kind == "phone":
        code = country_code(plain)
        new = code + reshape(plain[len(code) :], key, f"{tweak}|{code}", _phone_places(code))
        if not original.startswith("+"):
            return _spread(new[1:], original, str.isdigit)
        return "(0)".join(_spread(part, piece, str.isdigit) for part, piece in _cut(new, original.split("(0)")))
    if kind == "iban":
        country, check, rest = plain[:2], int(plain[2:4]), plain[4:]
        new = reshape(rest, key, f"{tweak}|{country}", _upper_alnum)
        off = (check - iban_check(country, rest)) % 100  # none where the check digits are right
        return _spread(f"{country}{(iban_check(country, new) + off) % 100:02d}{new}", original, lambda c: c != " ")
    if kind == "ssn":
        return _spread(reshape(plain, key, tweak, _alnum), original, str.isdigit)
    if kind == "first":
        if salt:
            return _cased(reshape(_lower(original), key, tweak, _shaped), original)
        return "-".join(_first_name(part, gender, key, tweak) for part in original.split("-"))
    return _cased(reshape(_lower(original), key, tweak, _shaped), original)


def _cut(new: str, pieces: list[str]):
    """Each piece of a layout with the digits that belong in it."""
    at = 0
    for piece in pieces:
        n = sum(map(str.isdigit, piece))
        yield new[at : at + n], piece
        at += n


# detection


def _cards(text: str, run: re.Match) -> list[Entity]:
    """Cards in a run of digit groups: from each group the longest whole groups of 13 to 19 digits with a right check digit."""
    if run.end() - run.start() < 13:
        return []
    groups = [(run.start() + g.start(), run.start() + g.end()) for g in re.finditer(r"\d+", run.group())]
    open_end = text[run.end() : run.end() + 1] == "-"  # the last group goes on beyond the run
    out, i = [], 0
    while i < len(groups):
        digits, best = "", None
        for j in range(i, len(groups) - open_end):
            if groups[j][1] - groups[j][0] + len(digits) > 19:
                break
            digits += text[groups[j][0] : groups[j][1]]
            if len(digits) >= 13 and digits.isascii() and luhn(digits[:-1]) == int(digits[-1]):
                best = j
        if best is not None:
            out.append(Entity(groups[i][0], groups[best][1], "card"))
            i = best
        i += 1
    return out


def _emails(text: str) -> list[Entity]:
    """Addresses around each ``@``; what lies between two of them is looked at once from either side."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and (text[lo - 1].isascii() and text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
            lo -= 1
        while lo < at and not text[lo].isalnum():
            lo += 1
        floor = at + 1
        if lo < at and (m := HOST.match(text, at + 1)):
            out.append(Entity(lo, m.end(), "email"))
            floor = m.end()
        at = text.find("@", floor)
    return out


def _is_name(word: str) -> bool:
    return len(word) > 1 and word not in TITLES and any(map(str.islower, word))


def _name_end(text: str, tokens: list[tuple[int, int]], i: int) -> int | None:
    """Index of the last name that token ``i`` begins a full name with: initials and particles may stand between."""
    for j in range(i + 1, min(i + 4, len(tokens))):
        gap, word = text[tokens[j - 1][1] : tokens[j][0]], text[tokens[j][0] : tokens[j][1]]
        initial = j > i + 1 and tokens[j - 1][1] - tokens[j - 1][0] == 1
        if not (gap == " " or gap == ". " and initial or len(gap) <= 16 and gap[:1] == gap[-1:] == " " and set(gap.split()) <= PARTICLES):
            return None
        if _is_name(word):
            return j
        if len(word) != 1 or text[tokens[j][1] : tokens[j][1] + 1] != ".":
            return None
    return None


def _names(text: str, contacts: list[Entity]) -> tuple[list[Entity], list[tuple[int, int]]]:
    """Names, and all capitalised words."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    out, i, c = [], 0, 0
    while i < len(tokens):
        start, end = tokens[i]
        word = text[start:end]
        if word in TITLES:
            gender, j = "n", i
            while text[tokens[j][0] : tokens[j][1]] in TITLES:
                gender = TITLES[text[tokens[j][0] : tokens[j][1]]] if gender == "n" else gender
                if j + 1 == len(tokens) or text[tokens[j][1] : tokens[j + 1][0]] not in (" ", ". "):
                    break
                j += 1
            else:
                if _is_name(text[tokens[j][0] : tokens[j][1]]):
                    last = _name_end(text, tokens, j) or j
                    out.append(Entity(tokens[j][0], tokens[last][1], "name", gender))
                    i = last + 1
                    continue
            i = max(i + 1, j)
            continue
        if _is_name(word) and (last := _name_end(text, tokens, i)):
            stop = tokens[last][1]
            found = any(n in LISTED for n in word.split("-"))
            if not found and word not in NOT_NAMES and text[tokens[last][0] : stop] not in NOT_NAMES:
                found = bool(BEFORE.search(text, max(0, start - 24), start) or AFTER.match(text, stop))
                while c < len(contacts) and contacts[c].end + NEAR < start:
                    c += 1
                for k in contacts[c : c + 2]:
                    lo, hi = (stop, k.start) if k.start >= stop else (k.end, start)
                    found = found or 0 <= hi - lo <= NEAR and "\n" not in text[lo:hi]
            if found:
                out.append(Entity(start, stop, "name"))
                i = last + 1
                continue
        i += 1
    return out, tokens


def _found(text: str) -> tuple[list[Entity], list[tuple[int, int]]]:
    """Entities in order without overlaps, and all capitalised words."""
    found: list[Entity] = []
    if re.search(r"\d[\d.() -]{5}", text):
        for kind, pattern in PATTERNS.items():
            for m in pattern.finditer(text):
                if kind == "card":
                    found += _cards(text, m)
                elif m.group().isascii() and (kind != "phone" or 7 <= sum(map(str.isdigit, m.group())) <= 15):
                    found.append(Entity(m.start(), m.end(), kind))
    if "@" in text:
        found += _emails(text)
    names, tokens = _names(text, sorted(found))
    order = sorted(found + names, key=lambda e: (e.start, -e.end, KINDS.index(e.kind)))
    out, end = [], 0
    for e in order:
        if e.start >= end:
            end = e.end
            out.append(e)
    return out, tokens


def detect(text: str) -> list[tuple[int, int, str]]:
    """Entities ``(start, end, kind)`` in order, without overlaps; code points, end exclusive."""
    return [e[:3] for e in _found(text)[0]]


class Pair(NamedTuple):
    """An original in canonical form and what it became, in canonical form too."""

    kind: str
    original: str
    surrogate: str


def replace(text: str, key: bytes = KEY, salts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities found in the original."""
    new, entities, _ = replaced(text, key, salts)
    return new, entities


def replaced(text: str, key: bytes = KEY, salts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[int, int, str]], set[Pair]]:
    """The text with surrogates, the entities found in the original, and which original became which surrogate."""
    entities, tokens = _found(text)
    if not entities:
        return text, [], set()
    salts, pairs, bearers, parts = salts or {}, set(), {}, []

    def make(kind: str, value: str, gender: str = "n") -> str:
        plain = canonical(kind, value)
        if kind == "first" and value in LISTED and gender not in ("n", LISTED[value][0]):
            plain = f"{gender}:{plain}"
        out = surrogate(kind, value, key, gender, salts.get((kind, plain), 0))
        pairs.add(Pair(kind, plain, canonical(kind, out)))
        return out

    for e in entities:
        value = text[e.start : e.end]
        if e.kind != "name":
            parts.append((e.start, e.end, e.kind, make(e.kind, value)))
            continue
        words = [m.span() for m in TOKEN.finditer(value)]
        for k, (s, t) in reversed(list(enumerate(words))):
            word = value[s:t]
            first = k == 0 and (len(words) > 1 or word in LISTED)
            known = bearers.get(word)
            new = known[0] if known and known[1] == first else make("first", word, e.gender) if first else make("last", word)
            if len(word) > 1:
                bearers.setdefault(word, (new, first))
            value = value[:s] + new + value[t:]
        parts.append((e.start, e.end, "name", value))
    if bearers:  # coreference: part of a bearer's name alone
        k, taken = 0, [(s, e) for s, e, _, _ in parts]
        for s, e in tokens:
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if text[s:e] in bearers and (k == len(taken) or e <= taken[k][0]):
                parts.append((s, e, "name", bearers[text[s:e]][0]))
        parts.sort()
    out, at = [], 0
    for start, end, _, new in parts:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [(s, e, k) for s, e, k, _ in parts], pairs


# tables


def entity_pairs(docs: DataFrame, key: bytes = KEY, salts: dict | None = None) -> DataFrame:
    """``(kind, original, surrogate)``, canonical, of all entities of the corpus; once for each batch of texts."""

    def make():
        def run(texts):
            met = {p for t in texts if t for p in replaced(t, key, salts)[2]}
            return {"kind": [p.kind for p in met], "original": [p.original for p in met], "surrogate": [p.surrogate for p in met]}

        return run

    return map_columns(docs.select(F.col("text").cast("string").alias("text")), "kind string, original string, surrogate string", make)


def shared_surrogates(pairs: DataFrame) -> DataFrame:
    """``(kind, surrogate, originals)`` for surrogates that several originals have.

    Pairs are counted once before they meet, so a frequent entity is one row; who meets at a surrogate are its
    few different originals.
    """
    met = pairs.distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("original")).alias("originals"))
    return met.where("n > 1").drop("n")


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(kind, surrogate, originals)``: surrogates that several originals of the corpus share before any is resolved."""
    return shared_surrogates(entity_pairs(docs, key))


def resolve(docs: DataFrame, key: bytes = KEY) -> dict[tuple[str, str], int]:
    """Which permutation each colliding original takes so that no surrogate of the corpus is shared; empty but by accident."""
    salts: dict[tuple[str, str], int] = {}
    for _ in range(8):
        met = shared_surrogates(entity_pairs(docs, key, salts)).collect()  # permutations don't collide: a handful at most
        if not met:
            return salts
        for r in met:
            for original in r.originals[1:]:
                salts[r.kind, original] = salts.get((r.kind, original), 0) + 1
    raise RuntimeError("surrogates still collide after eight permutations")


def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(doc_id, text, n_entities, entities)`` for every row; entities as ``kind:start:end`` of the original."""
    salts = resolve(docs, key)

    def make():
        def run(ids, texts):
            done = [(None, []) if t is None else replace(t, key, salts) for t in texts]
            return {"doc_id": ids, "text": [t for t, _ in done], "n_entities": [len(e) for _, e in done], "entities": [",".join(f"{k}:{s}:{x}" for s, x, k in e) for _, e in done]}

        return run

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_entities int, entities string", make)


def redact(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; all other columns and the order of columns stay."""
    salts = resolve(docs, key)

    redacted = map_values("string", lambda: lambda texts: [None if t is None else replace(t, key, salts)[0] for t in texts])
    return docs.withColumn("text", redacted(F.col("text").cast("string")))
