"""Personal data replaced by surrogates of the same type, gender, script and format.

A surrogate is the image of the entity under a keyed permutation of all strings of its format, so the
same entity has the same surrogate everywhere (no table of entities is kept or joined), two entities
never share one, and none is its own surrogate.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import arrays
from tracewell.llm.pretokens import classes
from tracewell.session import materialise

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. n-1 without a fixed point (for n > 1): a shift by one in the order that a Feistel network gives."""

    def __init__(self, n: int, tweak: str, key: bytes):
        self.n, self.key, self.tweak = n, hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()
        self.a = isqrt(max(0, n - 1)) + 1
        self.b = -(-n // self.a)

    def _f(self, i: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        raw = b"".join(hashlib.blake2b(b"%d|%d|%d|" % (i, x, j) + self.tweak, key=self.key, digest_size=min(64, size - j)).digest() for j in range(0, size, 64))
        return int.from_bytes(raw, "big") % modulus

    def _walk(self, x: int, rounds: list[int], sign: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in rounds:
                if i % 2:
                    right = (right + sign * self._f(i, left, self.b)) % self.b
                else:
                    left = (left + sign * self._f(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        there = (self._walk(x, list(range(ROUNDS)), 1) + 1) % self.n
        return self._walk(there, list(range(ROUNDS - 1, -1, -1)), -1)


def _span(first: str, last: str, without: str = "") -> str:
    return "".join(chr(c) for c in range(ord(first), ord(last) + 1) if chr(c) not in without)


_VOWELS = "aeiouyаеиоуыэюяαεηιουω"
#: Alphabets by script and case; a letter is replaced by one of its alphabet.
_ALPHABETS = ["0123456789", _span("a", "z"), _span("A", "Z"), _span("ß", "ÿ", "÷"), _span("À", "Þ", "×"), _span("а", "я"), _span("А", "Я"), _span("α", "ω", "ς"), _span("Α", "Ω", "΢")]
_ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}


def _sound(c: str) -> str:
    """The vowels or the consonants of c's alphabet, whichever it is one of."""
    vowel = c.lower() in _VOWELS
    return "".join(x for x in _ALPHABET_OF.get(c, c) if (x.lower() in _VOWELS) == vowel)


def permute_text(text: str, tweak: str, key: bytes, alphabet: Callable[[str], str] = lambda c: _ALPHABET_OF.get(c, c), fits: Callable[[str], bool] = lambda s: True) -> str:
    """The surrogate of text among all strings with the same alphabet at each place that fits."""
    sets = [alphabet(c) for c in text]
    x = n = 0
    n = 1
    for c, s in zip(text, sets):
        x, n = x * len(s) + s.index(c), n * len(s)
    permutation = Permutation(n, f"{tweak}|{'|'.join(s[0] if len(s) == 1 else s[0] + str(len(s)) for s in sets)}", key)
    while True:
        x = permutation(x)
        y, out = x, []
        for s in reversed(sets):
            y, r = divmod(y, len(s))
            out.append(s[r])
        made = "".join(reversed(out))
        if fits(made):
            return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _laid_out(digits: str, form: str) -> str:
    """digits in the places of the digits of form."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    body = digits[0] + permute_text(digits[1:-1], f"card{digits[0]}", key)
    return _laid_out(body + next(c for c in "0123456789" if luhn(body + c)), text)


_PRIVATE = [(10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (127 << 24, 8)]


def _network(n: int) -> tuple[int, int] | None:
    return next(((base, bits) for base, bits in _PRIVATE if n >> (32 - bits) == base >> (32 - bits)), None)


def _ip(text: str, key: bytes) -> str:
    n = 0
    for part in text.split("."):
        n = n << 8 | int(part)
    net = _network(n)
    if net:
        free = 32 - net[1]
        n = net[0] | Permutation(1 << free, f"ip{net[0]}", key)(n & ((1 << free) - 1))
    else:
        permutation = Permutation(1 << 32, "ip", key)
        n = permutation(n)
        while _network(n):
            n = permutation(n)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


#: Networks of addresses of version 6 that stay apart from others: link-local and unique local ones.
_PRIVATE6 = [(0xFE80 << 112, 10), (0xFC << 120, 7)]


def _network6(n: int) -> tuple[int, int] | None:
    return next(((base, bits) for base, bits in _PRIVATE6 if n >> (128 - bits) == base >> (128 - bits)), None)


def _ip6(text: str, key: bytes) -> str:
    """All forms of an address have one surrogate, in the form of the original: groups of four digits, shorter groups, or the short form; in lower case."""
    n = int(IPv6Address(text))
    net = _network6(n)
    if net:
        free = 128 - net[1]
        n = net[0] | Permutation(1 << free, f"ip6{net[1]}", key)(n & ((1 << free) - 1))
    else:
        permutation = Permutation(1 << 128, "ip6", key)
        n = permutation(n)
        while _network6(n):
            n = permutation(n)
    full = IPv6Address(n).exploded
    if "::" in text:
        made = str(IPv6Address(n))
    else:
        made = full if all(len(g) == 4 for g in text.split(":")) else ":".join(g.lstrip("0") or "0" for g in full.split(":"))
    return made


def _iban_rest(text: str) -> int:
    """The number that the check digits make 1, modulo 97."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str:
    """The country stays, letters and digits of the account stay such, and the check digits are right."""
    plain = text.replace(" ", "")
    body = permute_text(plain[4:], f"iban{plain[:2]}", key)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    made = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(made) for c in text)


def _ssn(text: str, key: bytes) -> str:
    return _laid_out(permute_text(text.replace("-", ""), "ssn", key, fits=_is_ssn), text)


def _is_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: Country codes of one and two digits; the others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def _number(text: str) -> tuple[str, str]:
    """Country code and the digits behind it."""
    digits = re.sub(r"\D", "", text)
    country = _COUNTRY.match(digits)[0] if text[0] == "+" else "1" if len(digits) == 11 and digits[0] == "1" else ""
    return country, digits[len(country) :]


def _phone(text: str, key: bytes) -> str:
    """The country code stays, and whether the number behind it begins with 0; one without a country is of 1, as is one of eleven digits from 1 on."""
    country, rest = _number(text)
    form = lambda s: "0" if s[0] == "0" else len(s) == 11 and s[0] == "1"
    return _laid_out(country + permute_text(rest, f"phone{country or 1}", key, fits=lambda s: form(s) == form(rest)), text)


def _low(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _cased(made: str, form: str) -> str:
    return "".join(m.upper() if o.isupper() and len(m.upper()) == 1 else m for o, m in zip(form, made))


def _email(text: str, key: bytes) -> str:
    """Letters and digits of all but the top-level domain; case follows the original, so that spellings of one address agree."""
    low = _low(text)
    stop = low.rindex(".")
    return _cased(permute_text(low[:stop], "email", key) + low[stop:], text)


# Titles by gender, and given names by script and gender.
_TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Senora Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Senor Sr Господин Κύριος".split(), "": ["Dr", "Doktor", "Prof", "Professor"]}
_GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Camille Carmen Clara Elena Emma Greta Helen Ines Julia Karin Laura Lucía Maria Marie Nina Olga Paula Rosa Sarah Sophie Ursula".split(),
    ("latin", "m"): "Albert Bernard Carlos Daniel Diego Erik Felix Frank Georg Hans Henri James John José Karl Louis Manuel Michael Otto Paul Peter Robert Stefan Thomas".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Дмитрий Иван Михаил Николай Пётр Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
_GIVEN_OF = {name: group for group, names in _GIVEN.items() for name in names}
_GIVEN_LOW = {_low(name): name for name in _GIVEN_OF}
_GENDER_OF = {t: g for g, titles in _TITLES.items() for title in titles for t in (title, title.upper())}
#: Endings of family names by gender, the masculine before the feminine. None is the end of another.
_ENDINGS = [("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"), ("ский", "ская"), ("цкий", "цкая"), ("ov", "ova"), ("ev", "eva"), ("ski", "ska"), ("cki", "cka")]
_ENDING = re.compile("(?:" + "|".join(e for pair in _ENDINGS for e in pair) + ")$")
_PAIR_OF = {e: i for i, pair in enumerate(_ENDINGS) for e in pair}
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_TITLE = "(?:" + "|".join(sorted(_GENDER_OF, key=len, reverse=True)) + r")\b\.?[ \u00a0]"
_PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{_TITLE})(?:{_TITLE})*(?P<names>{_NAME}(?:[ \u00a0]{_NAME})?)|(?P<given>" + "|".join(sorted([*_GIVEN_OF, *map(str.upper, _GIVEN_OF)], key=len, reverse=True)) + rf")[ \u00a0](?P<family>{_NAME}))(?!\w)")


def _name(word: str, key: bytes) -> str:
    """A given name of the same script and gender, or else a name with vowels and consonants in the same places; case follows the original.

    The ending of a family name that tells the gender stays, and both genders of a family have one stem. Other names keep their
    last letter, which tells the gender of many given names that are not listed. So no two names have one surrogate.
    """
    low = _low(word)
    if low in _GIVEN_LOW:
        name = _GIVEN_LOW[low]
        names = _GIVEN[_GIVEN_OF[name]]
        made = names[Permutation(len(names), "given" + "".join(_GIVEN_OF[name]), key)(names.index(name))]
        return made.upper() if word.isupper() else made.lower() if word.islower() else made
    ending = _ENDING.search(low)
    if ending and ending.start() > 1:
        stem, both = low[: ending.start()], _ENDINGS[_PAIR_OF[ending[0]]]
        made = permute_text(stem, f"family-{both[0]}", key, _sound, lambda s: not any(s + e in _GIVEN_LOW for e in both))
        return _cased(made + ending[0], word)
    free = lambda s: s + low[-1] not in _GIVEN_LOW and not ((m := _ENDING.search(s + low[-1])) and m.start() > 1)
    return _cased(permute_text(low[:-1], f"family{low[-1]}", key, _sound, free) + low[-1], word)


_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def _mentions(text: str, people: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Where a name of one of these people stands alone later on, in the same letters and case or in capitals."""
    names: dict[str, int] = {}
    for a, b in sorted(people):
        for word in re.split("[ \u00a0]", text[a:b]):
            if len(word) > 2 and word[0].isupper():
                for form in (word, word.upper(), word.capitalize()):
                    names[form] = min(names.get(form, b), b)
    if names:
        for m in _WORD.finditer(text, min(names.values())):
            if names.get(m[0], len(text)) <= m.start():
                yield m.span()


def _person(text: str, key: bytes) -> str:
    return re.sub(r"[^  ]+", lambda m: _name(m[0], key), text)


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "ip": _ip, "ip6": _ip6, "ssn": _ssn, "phone": _phone, "person": _person}


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of an entity; the same for the same entity, and shared with no other."""
    return _MAKERS[kind](text, key)


def _mark(kind: str, text: str, key: bytes) -> str:
    """A keyed hash of an entity, the same for all its spellings and layouts."""
    plain = re.sub(r"\W", "", text) if kind in ("card", "iban", "ssn") else str(IPv6Address(text)) if kind == "ip6" else "{} {}".format(*(x or "1" for x in _number(text))) if kind == "phone" else _low(text)
    return hashlib.blake2b(f"{kind} {plain}".encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=16).hexdigest()


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)", re.ASCII)
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4}|(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)", re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?!\w)", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", re.ASCII)
_PHONE = re.compile(
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w+])\+[1-9]\d{3,14}(?:[ .-]\d{2,4}){0,4}(?!\d)"  # E.164, or grouped behind the area
    r"|(?<![\w.+-])1[ .-]?(?:\(\d{3}\) ?|(?<=[ .-])\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}([ .-])\d{3}\1\d{4}(?![\w-])"
    r"|(?<![\w.+/-])(?!\d\d([ /.-])\d\d\2\d{4}(?!\d))(?=(?:[ /.-]?\d){9,12}(?!\d))0[1-9]\d{0,3}(?:[ /.-]\d{2,8}){1,4}(?!\w|[/.:-]\d)"  # a trunk prefix
    r"|(?<![\w.+/-])0[1-9]\d{8,9}(?!\w|[/.:-]\d)|(?<![\w(])\(0\d{1,4}\)[ -]?\d{3,8}(?:[ .-]\d{2,4}){0,3}(?!\w|[/.:-]\d)",
    re.ASCII,
)
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_LOCAL = set("._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    i, last = text.find("@"), 0
    while i >= 0:
        start = i
        while start > last and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        while start < i and not text[start].isalnum():
            start += 1
        if start < i and text[i - 1] != "." and (m := _DOMAIN.match(text, i + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = i + 1
        i = text.find("@", last)


def _is_ip6(text: str) -> bool:
    """An address, and not one that has no host or is the own machine's."""
    try:
        return int(IPv6Address(text)) > 1
    except ValueError:
        return False


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in a text, in order and apart: of overlapping ones the earlier kind of email, iban, card, ip, ip6, ssn, phone, person."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(*m.span(), "iban") for m in _IBAN.finditer(text) if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and _iban_rest(plain) == 1]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0])) and len(set(m[0])) > 2]
    found += [(*m.span(), "ip") for m in _IP.finditer(text)]
    found += [(*m.span(), "ip6") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    found += [(*m.span(), "ssn") for m in _SSN.finditer(text) if _is_ssn(m[0].replace("-", ""))]
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    for m in _PERSON.finditer(text):
        a, b = m.span("names") if m["title"] else m.span()
        words = text[a:b].replace("\u00a0", " ").split(" ")
        while words and not words[-1][0].isupper():
            b -= len(words.pop()) + bool(words)
        if words and (m["title"] or len(words) > 1):
            found.append((a, b, "person"))
    found += [(a, b, "person") for a, b in _mentions(text, [(a, b) for a, b, kind in found if kind == "person"])]
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []  # in order of their starts
    for a, b, kind in found:
        at = bisect_left(starts, a)
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= starts[at]):
            starts.insert(at, a)
            out.insert(at, (a, b, kind))
    return out


_NEAR = np.zeros(128, bool)
_NEAR[list(b"0123456789 ().+-")] = True
_HEX = np.zeros(128, bool)
_HEX[list(b"0123456789abcdefABCDEF:")] = True


@lru_cache(maxsize=1)
def _trigger_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of titles and given names, sorted, and a bitmap of their low bits."""
    names = sorted({*_GENDER_OF, *_GIVEN_OF, *map(str.upper, _GIVEN_OF)})
    cp = np.array([ord(c) for w in names for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in names])
    hashes = np.sort(arrays.range_hashes(cp, np.concatenate([[0], ends[:-1]]), ends))
    table = np.zeros(1 << 16, bool)
    table[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return hashes, table


def may_have_entities(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents have what every entity has: an @, four digits among punctuation, two colons among hexadecimal digits, or a title or given name."""
    cp, at = arrays.code_points(data)
    edges = np.searchsorted(at, offsets)
    out = np.zeros(len(offsets) - 1, bool)
    if not len(cp):
        return out
    of = lambda places: np.searchsorted(edges, places, side="right") - 1
    out[of(np.flatnonzero(cp == 0x40))] = True
    digit = (cp >= 48) & (cp < 58)
    near = _NEAR[np.minimum(cp, 127)]
    step = np.flatnonzero(np.diff(near, prepend=False))
    count = np.diff(np.concatenate([[0], np.cumsum(digit)])[np.append(step, len(cp))])
    out[of(step[np.flatnonzero(count >= 4)])] = True
    hexadecimal = _HEX[np.minimum(cp, 127)]
    step = np.flatnonzero(np.diff(hexadecimal, prepend=False))
    count = np.diff(np.concatenate([[0], np.cumsum(cp == 0x3A)])[np.append(step, len(cp))])
    out[of(step[np.flatnonzero(count >= 2)])] = True
    letter = classes()[cp] == 0
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, table = _trigger_hashes()
    own = arrays.range_hashes(cp, a, b)
    maybe = np.flatnonzero(table[(own & np.uint64(0xFFFF)).astype(np.int64)])
    out[of(a[maybe[np.isin(own[maybe], hashes)]])] = True
    first = edges[:-1][(edges[:-1] > 0) & (edges[:-1] < len(cp))]  # a run that a document's start cuts in two
    out[of(first[letter[first] & letter[first - 1]])] = True
    cut = first[near[first] & near[first - 1] | hexadecimal[first] & hexadecimal[first - 1]]
    out[of(cut)] = True
    out[of(cut - 1)] = True
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))
_MARKS = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("replacement", T.StringType())]))
_ARROW_MARKS = pa.list_(pa.struct([("entity", pa.string()), ("replacement", pa.string())]))
_ARROW_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, entities): every whole text with its personal data replaced, and where that was.

    Kinds: email, iban (with right check digits), card (13 to 19 digits with a right check digit), ip (version
    4), ip6, ssn (laid out as 3-2-4 digits), phone, person (after a title, or a listed given name with a family name, and later
    mentions of one of these names alone in the text; a person of no listed given name and without a title is not found). entities has kind, start and end in code points of the
    original text, and replacement. Texts without any are as they were; a null text stays null, with an
    empty array. Repeated rows stay repeated; other columns are left out. The result is written to the
    shared folder, with keyed hashes of entities and replacements, and ValueError is raised where one
    replacement stands for several entities. Runs of digits alone, without + or a leading 0, are no phones.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("text", T.StringType()), T.StructField("entities", _FOUND), T.StructField("_marks", _MARKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            data, offsets = arrays.string_buffers(texts)
            for low, high in arrays.chunks(offsets):
                part = texts.slice(low, high - low)
                found: list[list[dict]] = [[] for _ in range(high - low)]
                marks: list[list[dict]] = [[] for _ in range(high - low)]
                changed, new = np.zeros(high - low, bool), []
                for d in np.flatnonzero(may_have_entities(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])).tolist():
                    text, last, pieces = part[d].as_py(), 0, []
                    if text is None:
                        continue
                    for a, b, kind in entities(text):
                        made = surrogate(kind, text[a:b], key)
                        pieces += [text[last:a], made]
                        last = b
                        found[d].append({"kind": kind, "start": a, "end": b, "replacement": made})
                        marks[d].append({"entity": _mark(kind, text[a:b], key), "replacement": _mark(kind, made, key)})
                    if pieces:
                        changed[d] = True
                        new.append("".join(pieces) + text[last:])
                if new:
                    spread = np.zeros(high - low, np.int64)
                    spread[changed] = np.arange(len(new))
                    part = pc.if_else(pa.array(changed), pa.array(new, pa.string()).take(pa.array(spread)), part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), part, pa.array(found, _ARROW_FOUND), pa.array(marks, _ARROW_MARKS)], names=[id_col, "text", "entities", "_marks"])

    made = materialise(docs.select(id_col, text_col).mapInArrow(run, schema), "surrogates")
    refuse_collisions(made)
    return made.drop("_marks")


def refuse_collisions(made: DataFrame) -> None:
    """Raises ValueError if a replacement in _marks stands for several entities."""
    pairs = made.select(F.explode("_marks").alias("m")).select("m.*").distinct()
    n = pairs.groupBy("replacement").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()
    if n:
        raise ValueError(f"{n} surrogates stand for several entities")


def collisions(docs: DataFrame, replaced: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A check of a run from its texts, besides pseudonymise's own: (kind, replacement, n) for replacements that stand for several entities. It has no rows.

    Spellings of one address, number or name in different layouts are compared in lower case, cards and phones by digits.
    """
    at = replaced.select(id_col, F.explode("entities").alias("e")).join(docs.select(id_col, F.col(text_col).alias("_text")), id_col)
    plain = lambda c: F.when(F.col("e.kind").isin("card", "phone"), F.regexp_replace(c, r"\D", "")).otherwise(F.lower(c))
    pairs = at.select("e.kind", plain(F.expr("substring(_text, int(e.start) + 1, int(e.end - e.start))")).alias("entity"), plain(F.col("e.replacement")).alias("replacement")).distinct()
    return pairs.groupBy("kind", "replacement").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
