"""Surrogates for personal data: keyed, of the same type, gender, script and format, and distinct.

Detected: e-mail addresses, phone numbers, IPv4 addresses, card and account numbers, social security
numbers, IBANs, and persons (a title or a known given name before capitalised names).

A surrogate is made by a keyed permutation: each character that carries information is replaced
within its own class (digit, vowel or consonant of its script and case), by a Feistel network over
the whole string whose rounds are keyed hashes. Separators, lengths, case and checksums (Luhn, IBAN)
stay. Given names are permuted within the list of their gender and script. So equal entities get
equal surrogates in all texts, and distinct ones of one format get distinct ones.

What a permutation can't exclude is checked over the whole table: a surrogate that equals its own
original or another real entity, or the surrogate of an entity of another format, is made anew with
the next attempt until none is left. From attempt `LONGER` on, surnames and e-mail addresses grow by two
letters with each attempt, so that a shape whose strings are all taken, such as one-letter names, has
room. Where `ATTEMPTS` don't do (nearly all numbers of a fixed length are real ones), an error is
raised, as distinctness can't be had. These exceptions are few; they are broadcast up to
`BROADCAST_ROWS` and joined to the texts beyond.

Defined results: null text stays null, with no entities; empty texts stay empty; overlapping matches
go to the earlier, then the longer one; rows that repeat get equal results; extra columns are
dropped. Texts are searched whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import staged

BROADCAST_ROWS, ATTEMPTS, LONGER, ROUNDS = 200_000, 64, 6, 8

#: What surnames and addresses grow by, in the script of their first letter.
_GROWTH = {"LATIN": "na", "CYRILLIC": "на", "GREEK": "να"}

# Given names by script and gender, and titles.
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sophie Claire Elena Maria Lucia Carmen Isabel Ingrid Heike Petra Sabine Camille Chloe Alice Susan".split(),
    ("latin", "m"): "John James Peter Paul David Michael Thomas Robert Hans Karl Stefan Juan Carlos Pedro Miguel Pierre Jean Louis Antoine Richard".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Павел Виктор".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Sir господин κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Doña Lady госпожа κυρία".split(), "": "Dr Prof Doctor Professor".split()}

_NAME = {g: (script, sex) for (script, sex), names in GIVEN.items() for g in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PATTERNS = {
    "email": re.compile(r"[\w+%-]+(?:\.[\w+%-]+)*@[\w-]+(?:\.[\w-]+)+"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "ipv4": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    "number": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
}
_SIGNS = re.compile(r"[0-9@]")
_PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.? +|(?=(?:{'|'.join(_NAME)})\b))(?P<names>(?=[^\W\d_a-zа-я]){_WORD}(?: +(?!and\b)(?=[A-ZÀ-ÞΑ-ΩΆ-ΏА-ЯЁ]){_WORD}){{0,2}})")


def _luhn(digits: list[int]) -> int:
    """The check sum modulo 10; 0 for a valid number."""
    doubled = [(d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10


def _iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlaps. Types of person parts are given_f, given_m and surname."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if _SIGNS.search(text):
        for kind, pattern in _PATTERNS.items():
            if kind != "email" or "@" in text:
                found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if kind != "iban" or _iban_ok(m[0])]
    for m in _PERSON.finditer(text):
        title, at = m["title"], m.start("names")
        words = [(at + w.start(), w[0]) for w in re.finditer(_WORD, m["names"])]
        known = _NAME.get(words[0][1].capitalize())
        sex = next((s for s, ts in TITLES.items() if title in ts), "")
        if not title and len(words) < 2:
            continue  # a given name alone, without a title, may be another word
        for i, (start, word) in enumerate(words):
            kind = "surname"
            if i == 0 and known and (len(words) > 1 or not title):
                kind = f"given_{known[1] or sex or 'm'}"
            found.append((start, start + len(word), kind))
    found.sort(key=lambda x: (x[0], x[0] - x[1]))
    out, end = [], 0
    for start, stop, kind in found:
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    return out


def _alphabets() -> dict[str, str]:
    """Character to its class: digits, and vowels and consonants of each script and case."""
    groups: dict[tuple[str, ...], list[str]] = {}
    vowels = set("aeiouyаеёиоуыэюяαεηιουω")
    ranges = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100), *range(0x386, 0x3CF), *range(0x401, 0x460)]
    for c in map(chr, ranges):
        if c.isdigit():
            groups.setdefault(("digit",), []).append(c)
        elif c.isalpha():
            plain = unicodedata.normalize("NFD", c.lower())[0]
            groups.setdefault((unicodedata.name(c).split()[0], "ascii" if c.isascii() else "more", "upper" if c.isupper() else "lower", "vowel" if plain in vowels else "consonant"), []).append(c)
    return {c: "".join(g) for g in groups.values() for c in g}


_CLASS = _alphabets()


def permuted(text: str, fixed: set[int], key: bytes, tweak: str) -> str:
    """A keyed permutation of the strings of one shape: places in `fixed` and characters without a class stay."""
    spots = [i for i, c in enumerate(text) if i not in fixed and c in _CLASS]
    if not spots:
        return text
    shape = "".join(_CLASS[c][0] if i in spots else c for i, c in enumerate(text))
    half = (len(spots) + 1) // 2
    sides, sizes = [0, 0], [1, 1]
    for n, i in enumerate(spots):
        side, letters = int(n >= half), _CLASS[text[i]]
        sides[side] = sides[side] * len(letters) + letters.index(text[i])
        sizes[side] *= len(letters)
    for r in range(ROUNDS):
        a, b = r % 2, 1 - r % 2
        seed = hashlib.blake2b(f"{tweak}\0{shape}\0{r}\0{sides[b]}".encode(), key=key, digest_size=64).digest()
        sides[a] = (sides[a] + int.from_bytes(seed, "big")) % sizes[a]
    out = list(text)
    for n in range(len(spots) - 1, -1, -1):
        side, letters = int(n >= half), _CLASS[text[spots[n]]]
        sides[side], digit = divmod(sides[side], len(letters))
        out[spots[n]] = letters[digit]
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of one entity."""
    key = hashlib.blake2b(key, digest_size=32).digest()
    tweak = f"{kind}\0{attempt}"
    if kind.startswith("given"):
        script, sex = _NAME.get(value.capitalize(), ("latin", kind[-1]))
        names = GIVEN[script, sex]
        order = sorted(names, key=lambda n: hashlib.blake2b(f"{tweak}\0{n}".encode(), key=key).digest())
        if value.capitalize() in names:  # one step along a keyed cycle: never itself
            new = order[(order.index(value.capitalize()) + 1 + attempt) % len(order)]
            return new.upper() if value.isupper() and len(value) > 1 else new
    if kind == "ipv4":
        private = ipaddress.ip_address(value).is_private
        number = f"{int(ipaddress.ip_address(value)):032b}"
        while True:  # walking along the permutation until the address is of the same kind keeps it a permutation
            number = _bits(number, key, tweak)
            if ipaddress.ip_address(int(number, 2)).is_private == private:
                return str(ipaddress.ip_address(int(number, 2)))
    digits = [i for i, c in enumerate(value) if c.isdigit()]
    if kind == "number":
        out = permuted(value, {digits[0], digits[-1]}, key, tweak)
        want, rest = _luhn([int(value[i]) for i in digits]), [int(out[i]) for i in digits[:-1]]
        last = next(d for d in range(10) if _luhn([*rest, d]) == want)
        return out[: digits[-1]] + str(last) + out[digits[-1] + 1 :]
    if kind == "iban":
        out = permuted(value, {0, 1, 2, 3}, key, tweak)
        plain = out.replace(" ", "")
        check = 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97
        return out[:2] + f"{check:02d}" + out[4:]
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        area = digits[next((n for n, i in enumerate(digits) if i >= (code.end() if code else 0)), 0)]
        return permuted(value, {*range(code.end() if code else 0), area}, key, tweak)
    if attempt >= LONGER:
        more = _GROWTH.get(unicodedata.name(value[0], " ").split(" ")[0], "na") * (attempt - LONGER + 1)
        value = more + value if kind == "email" else value + more if kind == "surname" else value
    if kind == "email":
        return permuted(value, set(range(value.rindex("."), len(value))), key, tweak)
    return permuted(value, set(), key, tweak)


def _bits(number: str, key: bytes, tweak: str) -> str:
    left, right = int(number[:16], 2), int(number[16:], 2)
    for r in range(ROUNDS):
        mask = int.from_bytes(hashlib.blake2b(f"{tweak}\0{r}\0{right}".encode(), key=key, digest_size=2).digest(), "big")
        left, right = right, left ^ mask
    return f"{left:016b}{right:016b}"


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int], memo: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities found."""
    found = find(text)
    if not found:
        return text, found
    memo = {} if memo is None else memo
    out, at = [], 0
    for start, stop, kind in found:
        value = text[start:stop]
        if (kind, value) not in memo:
            if len(memo) > 50_000:
                memo.clear()
            memo[kind, value] = surrogate(kind, value, key, attempts.get((kind, value), 0))
        out += [text[at:start], memo[kind, value]]
        at = stop
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, value) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text", 8 << 20):
            got = sorted({(k, t[a:b]) for t in batch.column("text").to_pylist() for a, b, k in find(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], ["kind", "value"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, value string").distinct()


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate can't be taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            new = [surrogate(k, v, key, a) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "attempt")), pa.array(new, pa.string())], ["kind", "value", "attempt", "new"])

    schema = "kind string, value string, attempt int, new string"
    family = F.regexp_replace("kind", "_.*", "")  # a given name of either gender is the same word
    real = found.select(family.alias("family"), F.col("value").alias("new")).distinct().withColumn("real", F.lit(True))
    table = staged(found.withColumn("attempt", F.lit(0)).mapInArrow(run, schema), "pii-surrogates")
    for attempt in range(ATTEMPTS + 1):
        # of several entities with one surrogate the least settled attempt, then the least value, keeps it
        named = table.withColumn("family", family)
        owner = named.groupBy("family", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "value")).alias("owner"))
        judged = named.join(owner, ["family", "new"]).join(real, ["family", "new"], "left")
        taken = F.col("real").isNotNull() & (F.col("kind").rlike("^given") == F.lit(False))
        lost = (F.col("n") > 1) & (F.col("owner") != F.struct("attempt", "kind", "value"))
        judged = staged(judged.select("kind", "value", "attempt", "new", (taken | lost).alias("bad")), "pii-judged")
        if judged.where("bad").isEmpty():
            break
        if attempt == ATTEMPTS:
            left = judged.where("bad").groupBy("kind").count().collect()
            raise ValueError(f"no distinct surrogates are left for {[tuple(r) for r in left]}")
        again = judged.where("bad").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(run, schema)
        table = staged(judged.where("not bad").select("kind", "value", "attempt", "new").unionByName(again), "pii-surrogates")
    return table.where("attempt > 0").select("kind", "value", "attempt")


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: id, n_entities, kinds (a sorted list, one for each entity) and the text with surrogates. Who knows `key` can undo them."""
    secret = key.encode()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    odd = staged(exceptions(staged(entities(source), "pii-entities"), secret), "pii-exceptions")
    few = odd.count() <= broadcast_rows
    shared = source.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in odd.collect()} if few else {})
    if few:
        source = source.withColumn("odd", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        source = _with_exceptions(source, odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str] = {}
        for batch in tv.chunks(batches, "text", 8 << 20):
            texts, kinds = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("odd").to_pylist(), strict=True):
                attempts = shared.value if own is None else {(o["kind"], o["value"]): o["attempt"] for o in own}
                new, found = replaced(text, secret, attempts, memo if own is None else None)
                texts.append(new)
                kinds.append(sorted(k for _, _, k in found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], [id_col, "n_entities", "kinds", "text"])

    kind = dict(docs.dtypes)[id_col]
    return source.select("id", "text", "odd").mapInArrow(run, f"`{id_col}` {kind}, n_entities bigint, kinds array<string>, text string")


def _with_exceptions(source: DataFrame, odd: DataFrame) -> DataFrame:
    """Each row with the exceptions among its own entities, by joins; for more exceptions than can be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text", 8 << 20):
            got = [sorted({(k, t[a:b]) for a, b, k in find(t)}) for t in batch.column("text").to_pylist()]
            kinds, values = ([[x[i] for x in g] for g in got] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("tie"), pa.array(kinds, pa.list_(pa.string())), pa.array(values, pa.list_(pa.string()))], ["tie", "kinds", "values"])

    keyed = source.withColumn("tie", F.sha2("text", 256))
    each = keyed.select("tie", "text").mapInArrow(run, "tie string, kinds array<string>, values array<string>").select("tie", F.explode(F.arrays_zip("kinds", "values")).alias("e")).select("tie", F.col("e.kinds").alias("kind"), F.col("e.values").alias("value"))
    lists = each.join(odd, ["kind", "value"]).groupBy("tie").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("odd"))
    return keyed.join(lists, "tie", "left").withColumn("odd", F.coalesce("odd", F.array().cast("array<struct<kind:string,value:string,attempt:int>>"))).drop("tie")
