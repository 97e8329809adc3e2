"""Operator 1, personal data and secrets replaced by surrogates.

Detected entities are replaced by keyed surrogates of the same kind and format: digits for digits, letters for letters of the same
script and case, separators kept, card numbers that pass the Luhn test still pass it, a name gets a name of the same gender and
script; a value with nothing to vary (a password of asterisks) gets one of its length out of letters and digits. A name is the run
of capitalised words and initials after a title or after words that introduce a name, or a run that begins with a common given
name; in scripts without capitals, the word beside a title. Its words are replaced wherever they stand in the document with a
capital letter, titled or not (coreference). A given name has one gender in all documents: the one its titles tell, none if they
tell both or neither. Initials turn by a key-given number of letters and take no part in the collision checks.

The surrogate depends on the secret key and the entity's kind and canonical form alone, so an entity has one surrogate in all
documents, however it is written. Over the table of distinct entities collision checks hold surrogates apart: none may be shared
by two entities, nor be an entity that occurs; who loses tries again with a counter. After many tries the surrogate grows by a
character; where a format is so short and so full that it can't, those left keep a surrogate that no other entity has, but which is
an entity that occurs.

The key is read from the setting `spark.triagemill.pii.key`; without it a key that anyone can read here is used, for tests.

Defined cases: a null text stays null, an empty one empty; rows with a null id are rewritten like others; repeated rows are
rewritten alike; entities that overlap go to the earlier kind; an empty table gives an empty result. Texts are searched whole.
Other columns, whatever their names, are returned as they are, but that one named like an added column is replaced by it.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.llm.common import HELD, arrow_map, doc_key, documents, held, materialize, release, salted_join, unheld, with_text

KEY_SETTING = "spark.triagemill.pii.key"
KEY = b"surrogate-key-1"
MAX_TRIES = 32
#: Tries after which a surrogate is one character longer.
GROW_AFTER = 8

_L = r"[^\W\d_]"
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Г-жа", "Κυρία")
_EITHER = ("Dr", "Prof", "Доктор")
_TITLES = "|".join(sorted(map(re.escape, _MALE + _FEMALE + _EITHER), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: (kind, what a text must hold to be searched, pattern); the group `v`, or else the whole match, is replaced. Earlier kinds win.
PATTERNS: list[tuple[str, str, re.Pattern]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")),
    ("secret", "=", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}=\s{0,3}[\"']?(?P<v>[^\s\"']{6,})")),
    ("secret", ":", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}:\s{0,3}[\"']?(?P<v>[^\s\"']{6,})")),
    ("secret", "A", re.compile(r"\b(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})\b")),
    ("secret", "_", re.compile(r"\bgh[pousr]_(?P<v>[A-Za-z0-9]{36,})")),
    ("secret", "sk-", re.compile(r"\bsk-(?P<v>[A-Za-z0-9]{20,})")),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", "", re.compile(r"(?<![\w.+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w.+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|\.\d)")),
    ("ssn", "-", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w.+])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\w-])")),
    ("ipv6", ":", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")),
    ("ip", ".", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)")),
]
_SPACE = re.compile(r"[ \t\xa0]+")
_TITLED = re.compile(rf"\b(?:(?:{_TITLES})\.?[ \t\xa0]+)+")
_TITLE = re.compile(rf"\b(?:{_TITLES})\b")
#: Words that a name follows.
_INTRODUCTIONS = ("my name is", "my name's", "mein name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут", "με λένε")
_INTRODUCED = re.compile(rf"\b(?i:{'|'.join(_INTRODUCTIONS)})[ \t\xa0]+")
#: Common given names that begin a name without a title: those of many men and women in English, German, French and Spanish.
GIVEN = {name: sex for sex, listed in {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Mark George Steven Kevin Hans Peter Klaus Wolfgang Jürgen Stefan Andreas Pierre Jean Michel Philippe Alain Antonio José Manuel Francisco Carlos Miguel Pedro Luis",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Anna Ursula Monika Petra Sabine Renate Helga Marie Nathalie Isabelle Sylvie Catherine María Carmen Josefa Isabel Laura Lucía",
}.items() for name in listed.split()}
#: A word that may be one of them, before another word.
_GIVEN = re.compile(rf"(?<![\w'’-])[A-Z][a-zà-ÿ]{{2,10}}(?=[ \t\xa0]+{_L})")
#: Letters of scripts without capitals.
_CASELESS = re.compile(r"[\u0590-\u1fff\u3040-\ud7af]")
#: Titles beside names in scripts without capitals: after the name, or before it.
_AFTER = re.compile(r"(?P<v>[\u4e00-\u9fff]{1,4}|[\u30a0-\u30ff]{2,10}|[\uac00-\ud7af]{2,4}?)[ ]?(?P<t>さん|様|氏|先生|女士|小姐|씨|님)")
_BEFORE = re.compile(r"(?P<t>\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?|السيدة|السيد|מר|גברת|श्रीमती|श्री)[ \t\xa0]+(?P<v>[^\W\d_A-Za-z\u00c0-\u052f]{1,20}(?:[ \t\xa0][^\W\d_A-Za-z\u00c0-\u052f]{1,20})?)")
_SEXED = {"女士": "f", "小姐": "f", "先生": "m", "السيدة": "f", "السيد": "m", "מר": "m", "גברת": "f", "श्रीमती": "f", "श्री": "m"}
_WORD = re.compile(rf"{_L}++(?:['’-]{_L}++)*+")
#: Small words inside a name; they stay, and what follows them is still the name.
_PARTICLES = frozenset("af al bin da de del della den der di do dos du el ibn la le ter van von y zu zum zur".split())
#: Letters that initials are exchanged within.
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_DIGIT = re.compile(r"[0-9]")
_NEEDS_DIGIT = {"iban", "card", "phone", "ssn", "ip"}


#: Ranges of letters by script; small letters where the script has case.
_RANGES = {
    "latin": ("a", "z"), "cyrillic": ("а", "я"), "greek": ("α", "ω"), "han": ("\u4e00", "\u9fa5"), "hiragana": ("\u3042", "\u3093"), "katakana": ("\u30a2", "\u30f3"),
    "hangul": ("\uac00", "\ud7a3"), "arabic": ("\u0627", "\u064a"), "hebrew": ("\u05d0", "\u05ea"), "devanagari": ("\u0915", "\u0939"), "armenian": ("\u0561", "\u0586"), "thai": ("\u0e01", "\u0e2e"), "georgian": ("\u10d0", "\u10f0"),
}
_BLOCKS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script_of(c: str) -> str:
    return next((name for name, low, high in _BLOCKS if low <= ord(c) <= high), "latin")


def script(text: str) -> str:
    return script_of(next((c for c in text if c.isalpha()), "a"))


def gender(titles: str) -> str:
    sexes = {"m" if t in _MALE else "f" if t in _FEMALE else "n" for t in _TITLE.findall(titles)} - {"n"}
    return sexes.pop() if len(sexes) == 1 else "n"


def name_word(m: re.Match) -> tuple[int, int]:
    """The span of a word without the ending of its genitive."""
    return m.start(), m.end() - (2 if m[0][-2:] in ("'s", "’s") and len(m[0]) > 2 else 0)


def name_run(text: str, at: int) -> list[tuple[int, int]]:
    """The spans of the capitalised words and initials that stand at `at` in a row, particles between them left out."""
    run: list[tuple[int, int]] = []
    while m := _WORD.match(text, at):
        start, end = name_word(m)
        if m[0][0].isupper():
            run.append((start, end))
        elif not run or m[0] not in _PARTICLES:
            break
        at = m.end()
        if end < at:
            break
        dotted = end - start == 1 and text[at : at + 1] == "."
        space = _SPACE.match(text, at + dotted)
        if not space and not dotted:
            break
        at = space.end() if space else at + 1
    # A single letter at the end, without a point, is a word ("Mr. Smith I think").
    while len(run) > 1 and run[-1][1] - run[-1][0] == 1 and text[run[-1][1] : run[-1][1] + 1] != ".":
        run.pop()
    return run


def names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the words of titled names, and of where they stand without a title."""
    runs, at = [], 0
    while m := _TITLED.search(text, at):
        run = name_run(text, m.end())
        at = run[-1][1] if run else m.end()
        if run:
            runs.append((gender(m[0]), run))
    titled = {span for _, run in runs for span in run}
    low = text.lower()
    begun = [(m.end(), False) for m in _INTRODUCED.finditer(text)] if any(x in low for x in _INTRODUCTIONS) else []
    begun += [(m.start(), True) for m in _GIVEN.finditer(text) if m[0] in GIVEN]
    for at, given in begun:
        run = name_run(text, at)
        # A given name alone is a word like others.
        if run and not titled & set(run) and (not given or len(run) > 1):
            titled |= set(run)
            runs.append((GIVEN.get(text[run[0][0] : run[0][1]], "n"), run))
    uncased = caseless(text)
    if not runs:
        return uncased
    found: dict[tuple[int, int], tuple[str, str]] = {}
    sexes: dict[str, set[str]] = {}
    family: set[str] = set()
    lone = []
    for sex, run in runs:
        whole = [x for x in run if x[1] - x[0] > 1]
        for start, end in run:
            word = text[start:end].lower()
            if end - start == 1:
                found[start, end] = ("initial", word)
            elif len(run) == 1:
                lone.append((start, end, word, sex))
            elif (start, end) == run[0] and len(whole) > 1:
                found[start, end] = ("given", word)
                sexes.setdefault(word, set()).add(sex)
            else:
                found[start, end] = ("family", word)
                family.add(word)
    for start, end, word, sex in lone:
        part = "given" if word in sexes and word not in family else "family"
        found[start, end] = (part, word)
        if part == "given":
            sexes[word].add(sex)
        else:
            family.add(word)
    for m in _WORD.finditer(text):
        span = name_word(m)
        word = text[span[0] : span[1]].lower()
        if span not in found and m[0][0].isupper() and (word in sexes or word in family):
            found[span] = ("family" if word in family else "given", word)
    out = []
    for (start, end), (part, word) in found.items():
        if part == "given":
            one = sexes[word] - {"n"}
            part = f"given-{one.copy().pop() if len(one) == 1 else 'n'}"
        out.append((start, end, f"name-{part}-{script(word)}" if part != "initial" else f"initial-{script(word)}", word))
    return out + uncased


def caseless(text: str) -> list[tuple[int, int, str, str]]:
    """Names in scripts without capitals, whole: beside a title, and wherever else the document has them."""
    if text.isascii() or not _CASELESS.search(text):
        return []
    sexes: dict[str, set[str]] = {}
    for pattern in (_AFTER, _BEFORE):
        for m in pattern.finditer(text):
            sexes.setdefault(m["v"], set()).add(_SEXED.get(m["t"]) or gender(m["t"].rstrip(".")))
    out: list[tuple[int, int, str, str]] = []
    at = 0
    if not sexes:
        return out
    for m in re.finditer("|".join(sorted(map(re.escape, sexes), key=len, reverse=True)), text):
        # One character is a name beside its title alone.
        if m.start() >= at and (len(m[0]) > 1 or _AFTER.match(text, m.start()) or any(x.span("v") == m.span() for x in _BEFORE.finditer(text, max(0, m.start() - 20)))):
            told = sexes[m[0]] - {"n"}
            out.append((m.start(), m.end(), f"name-given-{told.pop() if len(told) == 1 else 'n'}-{script(m[0])}", m[0]))
            at = m.end()
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of what is to be replaced, apart from each other and in order."""
    found: list[tuple[int, int, str, str]] = []
    digits = bool(_DIGIT.search(text))
    taken: list[tuple[int, int]] = []
    for kind, needs, pattern in PATTERNS:
        if needs not in text or (kind in _NEEDS_DIGIT and not digits):
            continue
        for m in pattern.finditer(text):
            start, end = m.span("v") if "v" in pattern.groupindex else m.span()
            if any(a < end and start < b for a, b in taken):
                continue
            value = text[start:end]
            taken.append((start, end))
            canon = value.lower() if kind == "email" else re.sub(r"\D", "", value) if kind in ("card", "phone", "ssn") else value.replace(" ", "") if kind == "iban" else value.lower() if kind == "ipv6" else value
            found.append((start, end, kind, canon))
    if not text.isascii() or any(c in text for c in " \t"):
        taken.sort()
        for name in names(text):
            # Those taken stand apart, so only the last that begins before the word's end can meet it.
            i = bisect.bisect_left(taken, (name[1],))
            if not i or taken[i - 1][1] <= name[0]:
                found.append(name)
    return sorted(found)


def stream(key: bytes, kind: str, canon: str, tries: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{canon}\0{tries}\0{block}".encode("utf-8", "surrogatepass"), hashlib.sha256)
        block += 1


def _like(text: str, numbers: Iterator[int], longer: int = 0) -> str:
    """Characters of the same class: lower-case hex for lower-case hex, digits for digits, letters for letters of their script and
    case; the rest stays. A text without any of these gets letters and digits instead; `longer` adds as many."""
    hexed = re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", text)
    draw = lambda n: (next(numbers) << 16 | next(numbers) << 8 | next(numbers)) % n
    out = []
    for c in text:
        if hexed:
            out.append("0123456789abcdef"[draw(16)])
        elif c.isdigit():
            # Digits of a script stand in tens.
            out.append(chr(ord(c) - int(c) + draw(10)) if c.isdecimal() else str(draw(10)))
        elif c.isalpha():
            low, high = map(ord, _RANGES[script_of(c)])
            made = chr(low + draw(high - low + 1))
            out.append(made.upper() if c.isupper() and len(made.upper()) == 1 else made)
        else:
            out.append(c)
    if not any(c.isalnum() for c in text):
        out = ["abcdefghijklmnopqrstuvwxyz0123456789"[draw(36)] for _ in text]
    return "".join(out) + "".join("abcdefghijklmnopqrstuvwxyz0123456789"[draw(36)] for _ in range(longer))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


#: Parts of invented names: onset and vowel syllables, then an ending by gender (or for family names).
SYLLABLES = {
    "latin": ("b d f g k l m n r s t v br dr gr kl st tr".split(), "a e i o u ei au".split(), {"m": ["n", "rd", "s", "ck"], "f": ["a", "ia", "ina", "elle"], "n": ["l", "m"], "": ["ner", "sen", "mont", "ley"]}),
    "cyrillic": ("б в г д ж к л м н п р с т".split(), "а е и о у".split(), {"m": ["н", "р", "слав"], "f": ["на", "ра", "ья"], "n": ["л", "м"], "": ["ов", "енко", "ский"]}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο ου".split(), {"m": ["ος", "ης"], "f": ["α", "η"], "n": ["ις"], "": ["ιδης", "ακης", "ου"]}),
}


def _name(kind: str, canon: str, numbers: Iterator[int], tries: int) -> str:
    _, part, *rest = kind.split("-")
    pick = lambda xs: xs[(next(numbers) << 8 | next(numbers)) % len(xs)]
    if rest[-1] not in SYLLABLES:
        # No invented names there: letters of the script, as many as the name has.
        return _like(canon, numbers, 0) + "".join(_like(canon[-1], numbers) for _ in range(tries // GROW_AFTER))
    onsets, vowels, endings = SYLLABLES[rest[-1]]
    return "".join(pick(onsets) + pick(vowels) for _ in range(3 + tries // GROW_AFTER)) + pick(endings["" if part == "family" else rest[0]])


def surrogate(key: bytes, kind: str, canon: str, tries: int = 0) -> str:
    """The canonical form of the entity's surrogate."""
    numbers = stream(key, kind, canon, tries)
    longer = tries // GROW_AFTER
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        kept = 2 if domain.endswith(("example.com", "example.org", "example.net")) else 1
        # A domain's surrogate depends on the domain alone, so that addresses of one domain stay together.
        names = [_like(x, stream(key, "domain", x, 0)) for x in labels[:-kept]] + labels[-kept:]
        return _like(local, numbers, longer) + "@" + ".".join(names)
    if kind.startswith("name-"):
        return _name(kind, canon, numbers, tries)
    if kind.startswith("initial-"):
        # A turn of the alphabet by the key: one to one, and no letter stays.
        low, high = map(ord, _RANGES[kind[8:]])
        turn = 1 + hmac.digest(key, kind.encode(), hashlib.sha256)[0] % (high - low)
        return chr(low + (ord(canon) - low + turn) % (high - low + 1)) if low <= ord(canon) <= high else _like(canon, numbers)
    if kind == "ip":
        return ".".join(str((1 if i == 0 else 0) + (next(numbers) << 8 | next(numbers)) % (223 if i == 0 else 256)) for i in range(4))
    if kind == "ipv6":
        return ":".join(f"{next(numbers) << 8 | next(numbers):x}" for _ in range(8))
    if kind == "phone":
        # A fictional exchange stays one; the leading digit (the country) stays.
        out = canon[0] + _like(canon[1:], numbers)
        return out[:-7] + "555" + out[-4:] if canon[-7:-4] == "555" else out
    if kind == "card":
        out = canon[0] + "".join(str((next(numbers) << 8 | next(numbers)) % 10) for _ in canon[1:])
        return next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn(x)) if luhn(canon) else out
    if kind == "iban":
        return canon[:2] + _like(canon[2:], numbers)
    if kind == "ssn":
        return _like(canon, numbers)
    return _like(canon, numbers, longer)


def shaped(kind: str, value: str, canon: str) -> str:
    """The canonical surrogate in the written form of the value it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(canon)
        return "".join(next(left, "") if c.isalnum() else c for c in value)
    if kind.startswith("initial-"):
        return canon.upper()
    if kind.startswith("name-"):
        return canon.upper() if value.isupper() and len(value) > 1 else canon[:1].upper() + canon[1:] if value[:1].isupper() else canon
    if kind == "email" and value.isupper():
        return canon.upper()
    return canon


def replace(text: str, key: bytes, given: dict[tuple[str, str], tuple[str, str]]) -> tuple[str, int]:
    """The rewritten text and its number of entities; given: of (kind, canon) the kind over all documents and the surrogate, where
    these aren't the kind as found and its first surrogate."""
    out, at = [], 0
    found = entities(text)
    for start, end, kind, canon in found:
        settled, made = given.get((kind, canon), (kind, None))
        out += [text[at:start], shaped(kind, text[start:end], surrogate(key, settled, canon) if made is None else made)]
        at = end
    return ("".join(out) + text[at:] if found else text), len(found)


def occurring(docs: DataFrame, rows: bool = False) -> DataFrame:
    """The distinct entities (kind, canon) of all documents; with `rows`, of each document (by its key)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, made = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = sorted({(k, c) for _, _, k, c in entities(text or "") if not k.startswith("initial-")})
            owner += [i] * len(found)
            made += found
        if not rows:
            made = sorted(set(made))
        columns = [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
        return pa.record_batch([batch.column("key").take(pa.array(owner, pa.int64())), *columns], ["key", "kind", "canon"]) if rows else pa.record_batch(columns, ["kind", "canon"])

    texts = docs.where("text IS NOT NULL")
    if rows:
        return arrow_map(texts.select(doc_key().alias("key"), "text"), work, "key binary, kind string, canon string")
    return arrow_map(texts.select("text"), work, "kind string, canon string").distinct()


def settled(found: DataFrame) -> DataFrame:
    """(kind, canon, settled): a given name has one kind in all documents, that of the only gender its titles tell, else of none."""
    given = F.col("kind").startswith("name-given-")
    script_of = F.substring_index("kind", "-", -1)
    sex = F.substring_index(F.substring_index("kind", "-", 3), "-", -1)
    told = F.when(sex != "n", sex)
    one = found.where(given).groupBy("canon", script_of.alias("_script")).agg(F.min(told).alias("_low"), F.max(told).alias("_high"))
    one = one.select("canon", F.concat(F.lit("name-given-"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("n"), F.lit("-"), F.col("_script")).alias("settled"))
    return found.where(given).join(one, "canon").select("kind", "canon", "settled").unionByName(found.where(~given).select("kind", "canon", F.col("kind").alias("settled")))


def assign(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, canon, tries, surrogate) of every distinct entity, after the collision checks."""

    def propose(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [surrogate(key, k, c, t) for k, c, t in zip(*(batch.column(x).to_pylist() for x in ("kind", "canon", "tries")))]
        return pa.record_batch([*batch.columns, pa.array(made, pa.string())], ["kind", "canon", "tries", "surrogate"])

    schema = "kind string, canon string, tries int, surrogate string"
    found = materialize(found, "pii-entities")
    current = materialize(arrow_map(found.withColumn("tries", F.lit(0)), propose, schema, "canon"), "pii-surrogates")
    lost = None
    for _ in range(MAX_TRIES):
        # Of those that share a surrogate the one that has tried least, then the least, keeps it.
        owner = current.groupBy("kind", "surrogate").agg(F.min(F.struct("tries", "canon")).alias("_owner"), F.count("*").alias("_n"))
        shared = current.join(owner.where("_n > 1"), ["kind", "surrogate"]).where(F.struct("tries", "canon") != F.col("_owner")).select("kind", "canon")
        real = found.select("kind", F.col("canon").alias("surrogate"))
        last, lost = lost, materialize(shared.union(current.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct(), "pii-collisions")
        release(last)
        if lost.isEmpty():
            return current
        kept = current.join(lost, ["kind", "canon"], "left_anti")
        again = current.join(lost, ["kind", "canon"], "left_semi").select("kind", "canon", F.col("tries") + 1)
        before, current = current, materialize(kept.unionByName(arrow_map(again.toDF("kind", "canon", "tries"), propose, schema, "canon")), "pii-surrogates")
        release(before)
    return apart(current, schema)


def apart(current: DataFrame, schema: str) -> DataFrame:
    """What is left after the last try, in formats with hardly more values than entities. A kind's canonical forms of one length are
    turned by one place in their order, which is one to one: a surrogate is another entity's form, and no two share it."""
    shared = current.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind", "surrogate")
    full = current.join(shared, ["kind", "surrogate"], "left_semi").select("kind", F.length("canon").alias("size")).distinct()
    # Kinds with lengths: a few hundred rows at most.
    turned = current.withColumn("size", F.length("canon")).join(F.broadcast(full), ["kind", "size"], "left_semi")
    order = Window.partitionBy("kind", "size").orderBy("canon")
    first = F.first("canon").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turned = turned.withColumn("surrogate", F.coalesce(F.lead("canon").over(order), first)).withColumn("tries", F.lit(-1))
    rest = current.withColumn("size", F.length("canon")).join(F.broadcast(full), ["kind", "size"], "left_anti")
    return materialize(rest.unionByName(turned, True).select("kind", "canon", "tries", "surrogate"), "pii-surrogates")


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The rows of `docs` with `text` rewritten and `_n_entities` added."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY.decode()).encode()
    occur = materialize(occurring(docs), "pii-occurring")
    kinds = materialize(settled(occur), "pii-kinds")
    made = assign(kinds.select(F.col("settled").alias("kind"), "canon").distinct(), key).where("tries <> 0").select(F.col("kind").alias("settled"), "canon", "surrogate", F.lit(True).alias("tried"))
    # Few entities have another kind over all documents or needed a second try: a document is joined with its own alone.
    other = kinds.join(made, ["settled", "canon"], "left").where("tried OR kind <> settled").select("kind", "canon", "settled", "surrogate")
    other = materialize(other, "pii-other")
    release(occur, kinds)
    rows = held(docs, doc_key().alias("key"))
    if other.isEmpty():
        given = rows.select(HELD, F.lit(None).cast("array<struct<kind:string,canon:string,settled:string,surrogate:string>>").alias("given"))
    else:
        found = occurring(docs, rows=True).distinct().withColumn("entity", F.struct("kind", "canon")).drop("kind", "canon")
        found = materialize(found, "pii-found")
        own = salted_join(found, other.select(F.struct("kind", "canon").alias("entity"), "settled", "surrogate"), "entity", found.count())
        own = materialize(own.groupBy("key").agg(F.collect_list(F.struct("entity.kind", "entity.canon", "settled", "surrogate")).alias("given")), "pii-given")
        release(found)
        given = rows.join(own, "key", "left").select(HELD, "given")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(HELD)
        made = [(None, 0) if t is None else replace(t, key, {(g["kind"], g["canon"]): (g["settled"], g["surrogate"]) for g in gs.as_py() or []}) for t, gs in zip(rows.field("text").to_pylist(), batch.column("given"))]
        return pa.record_batch([with_text(rows, [t for t, _ in made]), pa.array([n for _, n in made], pa.int64())], [HELD, "n"])

    schema = T.StructType([given.schema[HELD], T.StructField("n", T.LongType())])
    return unheld(arrow_map(given, work, schema), docs.columns, {"_n_entities": F.col("n")})


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("_n_entities").alias("n_entities"))
