"""Personal data replaced by surrogates.

E-mail addresses, IP addresses of both versions, international and national phone
numbers, card, account and social security numbers, secrets in assignments, access
keys, signed tokens, private key blocks and names after a title are found in whole texts. A run of
13 to 19 digits without groups is a card number only with a valid check digit.
Each entity gets a replacement that depends on a key, its kind and its canonical form
only, so the same entity reads the same in every document. Replacements keep the
format: digits stay digits, letters stay letters of their case and script, card and
account numbers keep valid check digits, phones their country code, names the
title's gender.

Coreference: within a document a titled name is one person with its later and earlier
untitled mentions, by the whole name, the given name or the surname, and with
"Mr Surname" where only one person of the document fits. Mentions take that part of the
person's replacement, or the whole of it where the part alone would also fit another
person. A single word that the document also writes in lower case is no untitled
mention, nor is a part that several persons share.

Distinct entities must stay distinct, and no replacement may be another entity
of the corpus: both are checked over all distinct entities, in rounds, by
partial aggregations and joins; an entity that collides gets its next
replacement. Those few are known to the tasks that rewrite texts: broadcast up
to MOST_BROADCAST of them, beyond that joined to the documents that hold them.

Defined results: null text stays null, text without entities stays as it is;
of colliding entities the first in order keeps its replacement, and a format so full
that MOST_ATTEMPTS replacements collide raises an error; rows that repeat
get equal results; overlapping finds go to the first kind in KINDS, phones without country code last; very long
texts are rewritten whole; other columns pass through ``rewritten`` unchanged.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import free_name, staged

#: Entities whose replacement isn't their first, up to which they are broadcast.
MOST_BROADCAST = 100_000
#: After so many collisions a replacement grows by one character a time.
GROWS_AFTER = 6
MOST_ATTEMPTS = 200

# Titles that tell a gender ("n": either), in several languages, and names of both.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "г-н"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Srta", "Signora", "Госпожа", "г-жа"),
          "n": ("Dr", "Prof", "Professor", "Mx")}
NAMES = {
    ("m", "LATIN"): "Adam Albert Anton Arthur Bernard Bruno Carl Daniel David Edgar Emil Felix Frank George Hugo Ivan Jacob Julian Karl Leo Louis Lucas Martin Max "
                    "Nicolas Oscar Otto Paul Peter Robert Samuel Simon Theodor Thomas Victor Walter William".split(),
    ("f", "LATIN"): "Ada Agnes Alice Anna Barbara Bella Carla Clara Diana Edith Elena Ella Emma Eva Flora Greta Hanna Helen Ida Irene Jana Julia Klara Laura Lena "
                    "Lisa Lucia Maria Marta Mira Nina Nora Olga Paula Rosa Sara Sofia Theresa Vera".split(),
    ("m", "CYRILLIC"): "Алексей Андрей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Пётр Роман Сергей Фёдор".split(),
    ("f", "CYRILLIC"): "Алла Анна Вера Галина Елена Ирина Лариса Мария Нина Ольга Раиса Софья Тамара Юлия".split()}

for _SCRIPT in ("LATIN", "CYRILLIC"):
    NAMES["n", _SCRIPT] = NAMES["m", _SCRIPT] + NAMES["f", _SCRIPT]

# Telephone country codes of one and of two digits; all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLE = "|".join(sorted((re.escape(t) for titles in TITLES.values() for t in titles), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind → pattern; the entity is the group ``e``. Order decides overlaps.
KINDS = {
    "secret": re.compile(r"""\b(?:api[_-]?key|access[_-]?key|secret|token|passwo?r?d|pwd)\b["']?\s*[:=]\s*["']?(?P<e>(?=[^\s"'&#]*\d)[^\s"'&#]{7,}[\w=/+])""", re.I),
    "key": re.compile(r"(?<![A-Za-z0-9])(?P<e>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9])"),
    "block": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<e>[A-Za-z0-9+/=\s]+)-----END"),
    "email": re.compile(r"(?<![\w.+-])(?P<e>[\w][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w@])"),
    "account": re.compile(r"(?<!\w)(?P<e>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"),
    "ip": re.compile(rf"(?<![\w.])(?P<e>(?:{_OCTET}\.){{3}}{_OCTET})(?![\w]|\.\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?P<e>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])(?P<e>(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4})(?![\w-])"),
    "phone": re.compile(r"(?<![\w+(])(?P<e>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}"
                        r"|(?<![./-])(?:00[1-9]\d{0,2}[ .-]\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3,5}\) ?\d{3,4}[ .-]?\d{3,4}|[2-9]\d\d([.-])\d{3}\2\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![/-]?\d|\.\d))(?!\w)"),
    "card": re.compile(r"(?<![\w.-])(?P<e>\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}([ -])\d{6}\2\d{5})(?![\w-]|\.\d)"),
    "name": re.compile(rf"(?<!\w)(?P<t>(?:{_TITLE})(?:\.?[ \t]+(?:{_TITLE})(?!\w))*)\.?[ \t]+(?P<e>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+)?)(?!\w)"),
}
_DIGITS = re.compile("[0-9]+")
_LOCAL = re.compile(r"[\w.+%-]")
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_MARKS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "sk_live_", "sk_test_", "eyJ")


def _places(text: str) -> Iterator[tuple[str, re.Match]]:
    """Matches of all kinds. Patterns are tried only where a cheap search finds what they need, so most of a text is passed over once."""
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            start = at
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            while start < at and not text[start].isalnum() and text[start] != "_":
                start += 1
            done = at + 1
            if found := KINDS["email"].match(text, start):
                yield "email", found
            at = text.find("@", done)
    if "=" in text or ":" in text:
        for found in KINDS["secret"].finditer(text):
            yield "secret", found
    if any(mark in text for mark in _MARKS):
        for found in KINDS["key"].finditer(text):
            yield "key", found
    if "PRIVATE KEY-----" in text:
        for found in KINDS["block"].finditer(text):
            yield "block", found
    if "::" in text or text.count(":") >= 7:
        for found in KINDS["ipv6"].finditer(text):
            yield "ipv6", found
    for run in _DIGITS.finditer(text):
        at = run.start()
        for kind, start in (("ip", at), ("card", at), ("ssn", at), ("phone", at - 1), ("phone", at), ("account", at - 2)):
            if start >= 0 and (found := KINDS[kind].match(text, start)):
                yield kind, found
    if any(title in text for title in _GENDER):
        for found in KINDS["name"].finditer(text):
            yield "name", found


def _canonical(kind: str, m: re.Match) -> str:
    """The entity without what its spelling adds."""
    entity = m.group("e")
    if kind == "name":
        told = [_GENDER[t] for t in re.findall(_TITLE, m.group("t"))]
        return f"{next((g for g in told if g != 'n'), 'n')}:{entity}"
    if kind == "email":
        return entity.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(entity).compressed
    if kind in ("card", "phone", "account"):
        plain = re.sub(r"[ .()/-]", "", entity)
        return "+" + plain[2:] if kind == "phone" and plain.startswith("00") else plain
    return entity


def _is_one(kind: str, m: re.Match) -> bool:
    """What a pattern can't say of an entity of its kind."""
    entity = m.group("e")
    if kind == "card":
        digits = re.sub("[ -]", "", entity)
        return 13 <= len(digits) <= 19 and (digits != entity or _luhn(digits) == 0)
    if kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(entity)
        except ValueError:
            return False
        return len(re.sub(":", "", entity)) >= 5 and any(c.isdigit() for c in entity) and int(address) > 0xFFFF
    if kind == "phone" and not entity.startswith("+"):
        return 9 <= sum(c.isdigit() for c in entity) <= 15
    if kind != "name":
        return True
    # "Main Dr Springfield" is a street.
    street = m.group("t") == "Dr" and m.string[m.end("t")] != "." and re.search(r"[^\W\d_a-z]\w*[ \t]$", m.string[max(0, m.start() - 40):m.start()])
    return entity[0].isupper() and not street


def _persons(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` with each titled name led to its person, and with the untitled mentions of the persons."""
    said = {e for *_, k, e in found if k == "name"}
    if not said:
        return found
    by_name: dict[str, set[str]] = {}
    for e in said:
        by_name.setdefault(e[2:], set()).add(e)

    def whole(e: str) -> str:
        """A title of either gender means the person of that name whose gender another title tells."""
        told = [o for o in by_name[e[2:]] if o[0] != "n"]
        return told[0] if e[0] == "n" and len(told) == 1 else e

    parts: dict[str, set[str]] = {}
    for e in map(whole, said):
        for word in e[2:].split(" ") if " " in e else ():
            parts.setdefault(word, set()).add(e)

    def person(e: str) -> str:
        fits = {o for o in parts.get(e[2:], ()) if o[2:].split(" ")[-1] == e[2:] and (e[0] == "n" or o[0] in ("n", e[0]))}
        return fits.pop() if len(fits) == 1 else whole(e)

    found = [(a, b, k, person(e) if k == "name" else e) for a, b, k, e in found]
    names = {name: {whole(e) for e in held} for name, held in by_name.items()}
    firsts = {name.split(" ")[0] for name in names if " " in name}
    low = {w for w in _WORD.findall(text) if w.islower()}
    more, words = [], list(_WORD.finditer(text))
    i = 0
    while i < len(words):
        start, end, word = *words[i].span(), words[i].group()
        i += 1
        if word in firsts and i < len(words) and text[end:words[i].start()] == " " and len(held := names.get(f"{word} {words[i].group()}", ())) == 1:
            more.append((start, words[i].end(), "name", next(iter(held))))
            i += 1
            continue
        held = parts.get(word, set()) | {person(e) for e in names.get(word, ())}
        if len(held) == 1 and len(word) > 1 and word.lower() not in low:
            more.append((start, end, "name", next(iter(held))))
    taken, out, at = found, [], 0
    for mention in more:
        while at < len(taken) and taken[at][1] <= mention[0]:
            out.append(taken[at])
            at += 1
        if at == len(taken) or mention[1] <= taken[at][0]:
            out.append(mention)
    return out + taken[at:]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity), in order, without overlaps."""
    taken: list[tuple[int, int, str, str]] = []
    ranks = {k: i for i, k in enumerate(KINDS)}

    def order(f: tuple[int, int, str, str]) -> int:
        # A number without a country code is a phone only where it is nothing else.
        return len(ranks) if f[2] == "phone" and text[f[0]] != "+" else ranks[f[2]]

    for kind, m in _places(text):
        if _is_one(kind, m):
            taken.append((*m.span("e"), kind, _canonical(kind, m)))
    kept: list[tuple[int, int, str, str]] = []
    for found in sorted(taken, key=lambda f: (f[0], order(f), -f[1])):
        if kept and found[0] < kept[-1][1]:
            if order(found) >= order(kept[-1]):
                continue
            # The loser began earlier: what of it lies before the winner may be an entity of its own.
            start, _, kind, _ = kept.pop()
            if start < found[0] and (shorter := KINDS[kind].match(text[:found[0]].rstrip(" "), start if kind != "name" else 0)) and shorter.start("e") == start and _is_one(kind, shorter):
                kept.append((start, shorter.end("e"), kind, _canonical(kind, shorter)))
        kept.append(found)
    return _persons(text, kept)


class Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.seed, self.block, self.left = key, "\x1f".join(what).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.seed + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _like(c: str, draw: Stream) -> str:
    """A character of the same class: digit, or letter of the same case and script."""
    if "0" <= c <= "9":
        return chr(48 + draw.below(10))
    if "a" <= c <= "z":
        return chr(97 + draw.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draw.below(26))
    if not c.isalpha():
        return c
    block, script = ord(c) & ~31, _script(c)
    near = [d for d in map(chr, range(block, block + 32)) if d.isalpha() and d.islower() == c.islower() and _script(d) == script]
    return near[draw.below(len(near))] if near else c


def _each(text: str, draw: Stream) -> str:
    return "".join(_like(c, draw) for c in text)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The entity's replacement in canonical form."""
    draw = Stream(key, kind, entity, str(attempt))
    more = "".join(chr(97 + draw.below(26)) for _ in range(max(0, attempt - GROWS_AFTER)))
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        names = [_each(label, Stream(key, "domain", label)) for label in labels[:-1]]
        return f"{_each(local, draw)}{more}@{'.'.join([*names, labels[-1]])}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = entity[0] + _each(entity[1:-1], draw)
        if _luhn(entity) == 0:
            return body + next(d for d in "0123456789" if _luhn(body + d) == 0)
        return body + str(draw.below(10))
    if kind == "ipv6":
        groups = entity.split(":") if attempt < GROWS_AFTER else ["0000"] * 8
        return ipaddress.IPv6Address(":".join("".join("0123456789abcdef"[draw.below(16) if i else 1 + draw.below(15)] for i in range(len(g))) for g in groups)).compressed
    if kind == "ssn":
        return f"{100 + draw.below(566):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    if kind == "phone":
        if entity[0] != "+":
            trunk = len(entity) - len(entity.lstrip("0"))
            return entity[:trunk + 1] + _each(entity[trunk + 1:], draw)
        code = next((n for n in (1, 2) if entity[1:1 + n] in CODES), 3)
        return entity[:1 + code] + _each(entity[1 + code:], draw)
    if kind == "account":
        body = _each(entity[4:], draw)
        return entity[:2] + (f"{98 - _mod97(body + entity[:2] + '00'):02d}" if _mod97(entity[4:] + entity[:4]) == 1 else _each(entity[2:4], draw)) + body
    if kind == "key":
        return "".join(_each(p, draw) if i % 2 == 0 else p for i, p in enumerate(re.split(r"(AKIA|ASIA|gh[oprsu]_|sk_live_|sk_test_|(?:^|(?<=\.))eyJ)", entity)))
    if kind == "block":
        return _each(entity, draw)
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-f]+", entity)
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity) if hexadecimal else _each(entity, draw) + more
    gender, _, name = entity.partition(":")
    words = re.split(r"([ -])", name)
    known = NAMES.get((gender, _script(name[0])))
    if known and attempt < GROWS_AFTER:
        return gender + ":" + known[draw.below(len(known))] + "".join(w if w in " -" else _each(w, draw) for w in words[1:])
    return gender + ":" + _each(name, draw) + more


def fitted(kind: str, original: str, canonical: str) -> str:
    """The canonical replacement in the format of the original."""
    if kind in ("card", "phone", "account"):
        rest = iter("00" + canonical[1:] if kind == "phone" and canonical[0] == "+" != original[0] else canonical)
        return "".join(c if c in " .()/-" else next(rest, "") for c in original) + "".join(rest)
    if kind == "ipv6":
        spelled = canonical if "::" in original else ipaddress.IPv6Address(canonical).exploded if len(original) == 39 else \
            ":".join(f"{int(g, 16):x}" for g in ipaddress.IPv6Address(canonical).exploded.split(":"))
        return spelled.upper() if original != original.lower() else spelled
    if kind == "name":
        name = canonical.partition(":")[2]
        return name.upper() if original.isupper() and len(original) > 1 else name
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(original, canonical, strict=False)) + canonical[len(original):]
    return canonical


def replaced(text: str | None, key: bytes, later: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The rewritten text, and what was replaced: kind and place in the original."""
    found = find(text or "")
    if not found:
        return text, []
    given = {(k, e): surrogate(key, k, e, later.get((k, e), 0)) for *_, k, e in found}
    holders: dict[str, set[str]] = {}
    for (k, e), new in given.items():
        for word in new[2:].split(" ") if k == "name" else ():
            holders.setdefault(word, set()).add(e)
    out, at = [], 0
    for start, end, kind, entity in found:
        new = given[kind, entity]
        if kind == "name" and " " in entity and text[start:end] != entity[2:]:
            part = new[2:].split(" ")[-1 if entity[2:].split(" ")[-1] == text[start:end] else 0]
            new = new[:2] + part if len(holders[part]) == 1 else new
        out += [text[at:start], fitted(kind, text[start:end], new)]
        at = end
    out.append(text[at:])
    return "".join(out), [{"kind": k, "start": s, "end": e} for s, e, k, _ in found]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = sorted({(kind, entity) for text in batch.column(0) for *_, kind, entity in find(text.as_py() or "")})
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], pa.string()) for i in (0, 1)], ["kind", "entity"])


def _replacements(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, attempts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, k, e, a) for k, e, a in zip(kinds, entities, attempts, strict=True)], pa.string())],
                                             ["kind", "entity", "attempt", "surrogate"])
    return run


def assignments(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, entity, attempt, surrogate) of every distinct entity, free of collisions."""
    entities = staged(docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").mapInArrow(_emit, "kind string, entity string").distinct())
    kinds = "kind string, entity string, attempt int, surrogate string"
    given = staged(entities.withColumn("attempt", F.lit(0)).mapInArrow(_replacements(key), kinds))
    while True:
        first = given.groupBy("kind", F.col("surrogate").alias("s")).agg(F.min(F.struct("attempt", "entity")).alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.col("kind").alias("k"), "s", F.col("w.entity").alias("winner"))
        doubled = given.join(first, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s"))).filter("entity <> winner").select("kind", "entity")
        real = entities.select(F.col("kind").alias("k"), F.col("entity").alias("s"))
        taken = given.join(real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_semi").select("kind", "entity")
        again = staged(doubled.unionByName(taken).distinct())
        if not again.count():
            return given
        full = given.join(again, ["kind", "entity"]).filter(F.col("attempt") >= MOST_ATTEMPTS).select("kind").first()
        if full:
            raise ValueError(f"no free replacement for an entity of kind {full[0]}: its format is full")
        retried = given.join(again, ["kind", "entity"]).select("kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(_replacements(key), kinds)
        given = staged(given.join(again, ["kind", "entity"], "left_anti").unionByName(retried))


def rewritten(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and ``_entities`` as last column, with more underscores where
    ``docs`` has such a one: kind, start and end of each in the original."""
    later = staged(assignments(docs, key, text_col).filter("attempt > 0").select("kind", "entity", "attempt"))
    names = docs.columns
    at = names.index(text_col)
    entities, sha, own_mark, own_fixes = (free_name(names, n) for n in ("_entities", "_sha", "_mark", "_fixes"))
    schema = docs.select("*", F.array().cast("array<struct<kind:string,start:int,end:int>>").alias(entities)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rewrite(batch: pa.RecordBatch, fixes) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            done = [replaced(t.as_py(), key, fixes(start + i)) for i, t in enumerate(part.column(at))]
            columns = list(part.columns[:len(names)])
            columns[at] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], kind)], [*names, entities])

    if later.count() <= most_broadcast:
        table = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in later.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from rewrite(batch, lambda _: table.value)
        return docs.mapInArrow(run, schema)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, e) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, e in {(k, e) for *_, k, e in find(t or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["mark", "kind", "entity"])

    mark = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    held = docs.select(mark.alias("mark"), F.col(f"`{text_col}`").alias("t")).filter("t IS NOT NULL").mapInArrow(holders, "mark string, kind string, entity string").distinct()
    fixes = held.join(later, ["kind", "entity"]).groupBy(F.col("mark").alias(own_mark)).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(own_fixes))
    joined = docs.withColumn(sha, mark).join(fixes, F.col(sha) == F.col(own_mark), "left").select(*[F.col(f"`{c}`") for c in names], own_fixes)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(len(names)).to_pylist()
            yield from rewrite(batch, lambda i, known=known: {(f["kind"], f["entity"]): f["attempt"] for f in known[i] or []})
    return joined.mapInArrow(run_joined, schema)
