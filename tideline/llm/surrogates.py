"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

One pass finds the mentions. Their distinct entities (an e-mail address in any case, a phone
number in any punctuation) form a table, and a keyed hash of entity and attempt draws each
one's surrogate. Surrogates that two entities share, or that are themselves an entity of the
texts, are drawn again with the next attempt until none is left, so that different entities
stay different and every mention of one entity gets the same replacement. A second pass
writes the surrogate in the format of each mention.

The words of a name are entities of their own, alike in any case, so a family name has one
surrogate beside any first name and title. Whether a word is a first or a family name, and a
first name's gender, come from all mentions and from lists of known first names; without
either the gender is drawn. Words differ as they are written, so names do: surrogate words
of different words differ whatever the title. A first name and its initial are not linked,
and people of one name are one entity. Names are found in scripts with capitals; surrogates
are Latin, Cyrillic or Greek, and Latin for all other scripts.

Keys stay with the caller: without the key surrogates cannot be traced back or repeated.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise

# Titles that tell a gender, and first names of either by script.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
NEUTRAL_TITLES = ("Dr", "Prof")
FIRST_NAMES = {
    ("LATIN", "f"): "Anna Clara Elena Emma Eva Ines Julia Laura Lena Lucia Maria Marta Nina Nora Paula Sara Sofia Vera".split(),
    ("LATIN", "m"): "Adam Boris David Emil Felix Hugo Jan Karl Leon Luis Marco Martin Max Oscar Paul Peter Robert Simon".split(),
    ("CYRILLIC", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Софья".split(),
    ("CYRILLIC", "m"): "Антон Борис Виктор Глеб Денис Иван Максим Олег Пётр Роман".split(),
    ("GREEK", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("GREEK", "m"): "Αλέξης Γιάννης Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Στέφανος".split(),
}
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(),
    "CYRILLIC": "ба ве го да же за ка ле ма не по ра се то ва ро ни ли".split(),
    "GREEK": "βα γε δο ζα θε κα λο μα νε πο ρα σε το φα χο".split(),
}

_TITLES = "|".join(sorted(map(re.escape, FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES), key=len, reverse=True))
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_GAP = r"[ \t\u00a0]+"
_TITLE_RUN = re.compile(rf"(?<!\w)(?:(?:{_TITLES})\.?{_GAP})+")
_TITLE = re.compile(rf"(?:{_TITLES})(?!\w)")
_INITIAL = re.compile(rf"({_LETTER})\.-?(?:{_GAP})?")
_WORD = re.compile(rf"(?:{_LETTER})+(?:['’-](?:{_LETTER})+)*")
_SPACE = re.compile(_GAP)
#: Words between names that are left as they are.
PARTICLES = frozenset("van von vom zu zum zur der den dem de da di do du del della des dos das la le ten ter bin ibn af av y e".split())
#: First names whose gender is known, besides the drawn ones.
KNOWN_NAMES = {
    "f": "Mary Jane Alice Sarah Susan Linda Karen Helen Margaret Elizabeth Catherine Barbara Ursula Monika Petra Heidi Claire "
    "Marie Camille Sophie Isabelle Carmen Pilar Isabel Teresa Rosa Lucía Inés María Sofía Наталья Татьяна Анастасия Светлана Αικατερίνη".split(),
    "m": "John James William George Thomas Charles Henry Michael Richard Joseph Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre "
    "Jean Jacques Louis François José Juan Carlos Miguel Pedro Antonio Manuel Сергей Александр Алексей Дмитрий Николай Γεώργιος".split(),
}

_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII)
# tried in this order; a later kind does not reach into an earlier one's mention
_KINDS = (
    ("email", re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*@(?:[\w-]+\.)+[^\W\d_]{2,}")),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)", re.ASCII)),
    ("card", _CARD),
    ("phone", re.compile(r"(?<![\w.+(])(?:\+\d{8,15}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d{2,8}(?:[ .-]\d{2,8}){1,4})(?![\w]|[.-]\d)", re.ASCII)),
    ("key", re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)", re.ASCII)),
    ("secret", re.compile(
        r"(?:token|secret|passw(?:or)?d|pwd|key|credentials?)[\w-]{0,40}[\"'`]?\s{0,8}(?::=|=>|[:=])\s{0,8}[\"'`]?([A-Za-z0-9+/_-]{16,}={0,2})(?![\w])",
        re.ASCII | re.IGNORECASE,
    )),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)),
)
NAME_KINDS = ("family", "first_f", "first_m", "first_n")
ALPHABETS = {
    "LATIN": "abcdefghijklmnopqrstuvwxyz",
    "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщъыьэюя",
    "GREEK": "αβγδεζηθικλμνξοπρστυφχψω",
}
_DIGIT_RUN = re.compile(r"\d+(?:[ -]\d+)*", re.ASCII)
#: Sizes of a card number's digit groups.
_CARD_GROUPS = re.compile(r"1[3-9]|4 4 4 [1-4]|4 4 4 4 [1-3]|4 6 [45]")
#: First digits of issuers of cards written in groups.
_ISSUERS = re.compile(r"[3-6]|2(?:2[2-9]|[3-6]|7[01]|720)")
_DIGITS = re.compile(r"\d", re.ASCII)


def _luhn(digits: str) -> int:
    """Sum of Luhn's check; valid numbers give a multiple of 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _script(word: str) -> str:
    name = next((unicodedata.name(c, "") for c in word if c.isalpha()), "")
    return next((s for s in SYLLABLES if name.startswith(s)), "LATIN")


def _is_name(word: str) -> bool:
    """Whether a part of the word starts with a capital, as in Meier, d'Alba or al-Said."""
    return any(part[:1].isupper() for part in re.split("['’-]", word))


def _names(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(titles, places of the name's words and initials) of each name after titles."""
    at = 0
    while m := _TITLE_RUN.search(text, at):
        at, places = m.end(), []
        pos = at
        while True:
            initial = _INITIAL.match(text, pos)
            if initial and initial[1][0].isupper():
                places.append(initial.span(1))
                pos = at = initial.end()
                continue
            word = _WORD.match(text, pos)
            if word is None or _TITLE.match(text, pos):
                break
            end = word.end() - 2 if word[0][-2:] in ("'s", "’s") else word.end()
            if _is_name(text[pos:end]):
                places.append((pos, end))
                at = word.end()
            elif word[0] not in PARTICLES:
                break
            gap = _SPACE.match(text, word.end())
            if gap is None or end < word.end():
                break
            pos = gap.end()
        if places:
            yield m[0], places


def _gender(titles: str) -> str:
    """Of the first title that tells one."""
    each = [t.rstrip(".") for t in titles.split()]
    return next(("f" if t in FEMALE_TITLES else "m" for t in each if t not in NEUTRAL_TITLES), "n")


_KNOWN = {n.lower(): g for g, names in [*((g, v) for (_, g), v in FIRST_NAMES.items()), *KNOWN_NAMES.items()] for n in names}


def _name_kind(gender: str, place: int, words: int, word: str) -> str:
    if len(unicodedata.normalize("NFC", word)) == 1:
        return "initial"
    return "family" if place == words - 1 else f"first_{gender}"


def normal(kind: str, raw: str) -> str | None:
    """What makes two mentions the same entity; None if the text is no entity of this kind."""
    if kind == "email":
        return raw.lower()
    if kind == "ip":
        return raw
    if kind == "card":
        digits = re.sub(r"\D", "", raw)
        return digits if _luhn(digits) == 0 else None
    if kind == "phone":
        digits = re.sub(r"\D", "", raw)
        plus = raw.startswith("+")
        return ("+" if plus else "") + digits if 9 <= len(digits) <= 15 or plus and len(digits) >= 8 else None
    if kind == "initial" or kind in NAME_KINDS:
        return unicodedata.normalize("NFC", raw).lower()
    if kind == "secret":
        return raw if re.search(r"\d", raw, re.ASCII) and re.search("[A-Za-z]", raw) else None
    return raw.replace(" ", "")


def mentions(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, entity, whether a mention starts) of the text, in order and without overlaps.

    Each word of a name is an entity of its own.
    """
    found: list[tuple[int, int, str, str, bool]] = []
    taken: list[tuple[int, int]] = []
    has_digit = _DIGITS.search(text) is not None
    for kind, pattern in _KINDS:
        if kind == "email" and "@" not in text or kind in ("ip", "card", "phone", "key", "secret", "iban") and not has_digit:
            continue
        places = _cards(text) if kind == "card" else (m.span(m.re.groups) for m in pattern.finditer(text))
        for start, end in places:
            entity = normal(kind, text[start:end])
            if entity is not None and not any(a < end and start < b for a, b in taken):
                found.append((start, end, kind, entity, True))
        taken = [x[:2] for x in found]
    for titles, places in _names(text):
        if any(a < places[-1][1] and places[0][0] < b for a, b in taken):
            continue
        for i, (start, end) in enumerate(places):
            kind = _name_kind(_gender(titles), i, len(places), text[start:end])
            found.append((start, end, kind, normal(kind, text[start:end]), i == 0))
    return sorted(found)


def resolved(found: DataFrame) -> DataFrame:
    """(kind, entity, as_kind) of the words of names: one kind for all mentions of a word.

    A word that ends a name of several words somewhere is a family name, and so is one that
    only stands alone and is no known first name. A first name has the gender it is known
    for, or else the one of the titles before it in any mention.
    """
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    words = found.where(F.col("kind").isin(*NAME_KINDS)).select(
        "entity", "kind", ((F.col("kind") == "family") & ~F.col("head")).alias("ends"), (F.col("kind") == "family").alias("last")
    )
    each = words.groupBy("entity").agg(
        F.max("ends").alias("ends"),
        F.max(~F.col("last")).alias("leads"),
        F.max(F.col("kind") == "first_f").alias("f"),
        F.max(F.col("kind") == "first_m").alias("m"),
        F.collect_set("kind").alias("kinds"),
    )
    gender = known[F.substring_index("entity", "-", 1)]
    titled = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    first = F.concat(F.lit("first_"), F.coalesce(gender, titled))
    kind = F.when(F.col("ends") | ~F.col("leads") & gender.isNull(), "family").otherwise(first)
    return each.select(F.explode("kinds").alias("kind"), "entity", kind.alias("as_kind"))


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """Places of card numbers: digit groups of a run as cards are written, then what else the pattern matches.

    A number in a longer run of digits ("order 3 4111111111111111") is tried at each group
    and for each size, undivided or in a card's groups.
    """
    taken: list[tuple[int, int]] = []
    for run in _DIGIT_RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\d+", run[0], re.ASCII)]
        fits = []
        for i, (start, _) in enumerate(groups):
            if i == 0 and start and re.match(r"[\w.+-]", text[start - 1]):
                continue
            for j in range(i, min(i + 5, len(groups))):
                end = groups[j][1]
                if j == len(groups) - 1 and re.match(r"[\w-]", text[end : end + 1]):
                    continue
                digits = re.sub(r"\D", "", text[start:end])
                if len(digits) > 19:
                    break
                sizes = " ".join(str(b - a) for a, b in groups[i : j + 1])
                if _CARD_GROUPS.fullmatch(sizes) and (i == j or _ISSUERS.match(digits)) and _luhn(digits) == 0:
                    fits.append((-len(digits), start, end))
        for _, start, end in sorted(fits):
            if not any(a < end and start < b for a, b in taken[-len(groups) :]):
                taken.append((start, end))
    yield from taken
    inside = sorted(taken)
    for m in _CARD.finditer(text):
        at = bisect.bisect_left(inside, (m.end(), 0))
        if at == 0 or inside[at - 1][1] <= m.start():
            yield m.span()


class _Draw:
    """Keyed digits and choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        self.seed = hmac.new(key, f"{kind}\0{entity}\0{attempt}".encode("utf-8", "replace"), hashlib.sha256).digest()
        self.pool, self.block = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.block += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big")
        self.pool, r = divmod(self.pool, n)
        return r

    def like(self, text: str) -> str:
        """Letters and digits of the same class and case; other characters stay."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = chr(97 + self.below(26)) if _script(c) == "LATIN" else SYLLABLES[_script(c)][self.below(len(SYLLABLES[_script(c)]))][0]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The surrogate entity, in normal form."""
    draw = _Draw(key, kind, entity, attempt)
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        *hosts, top = domain.split(".")
        return f"{draw.like(local)}@{'.'.join(draw.like(h) for h in hosts)}.{top}"
    if kind == "ip":
        parts = entity.split(".")
        private = 1 if parts[0] == "10" else 2 if parts[:2] == ["192", "168"] else 0
        first = [str(1 + draw.below(223))] if not private else []
        while first in (["10"], ["127"], ["172"], ["192"]):
            first = [str(1 + draw.below(223))]
        drawn = parts[:private] + first
        return ".".join(drawn + [str(1 + draw.below(254)) for _ in range(4 - len(drawn))])
    if kind == "card":
        body = entity[0] + "".join(str(draw.below(10)) for _ in entity[2:])
        return body + str((10 - _luhn(body + "0")) % 10)
    if kind == "phone":
        keep = 2 if entity[0] == "+" else 1
        return entity[:keep] + draw.like(entity[keep:])
    if kind in ("key", "iban"):
        keep = 4 if kind == "key" else 2
        return entity[:keep] + draw.like(entity[keep:])
    if kind == "secret":
        is_hex = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity)
        if is_hex is None:
            return draw.like(entity)
        hexes = "".join("0123456789abcdef"[draw.below(16)] for _ in entity)
        return hexes.upper() if entity.isupper() else hexes
    script = _script(entity)
    if kind == "initial":
        return _next_initial(key, script, entity)
    if kind == "family":
        syllables = SYLLABLES[script]
        parts = ["".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt // 8)) for _ in entity.split("-")]
        return "-".join(parts)
    names = FIRST_NAMES.get((script, kind[-1])) or FIRST_NAMES[script, "fm"[draw.below(2)]]
    # more names in a row where the single ones do not suffice
    return "-".join(names[draw.below(len(names))].lower() for _ in range(1 + attempt // 8))


def _next_initial(key: bytes, script: str, entity: str) -> str:
    """The next one in a keyed order of the alphabet, so that different initials stay different."""
    base, *marks = unicodedata.normalize("NFD", entity)
    letters = sorted(ALPHABETS[script], key=lambda c: hmac.new(key, c.encode(), hashlib.sha256).digest())
    if base not in letters:
        return entity
    return unicodedata.normalize("NFC", letters[(letters.index(base) + 1) % len(letters)] + "".join(marks))


def render(kind: str, raw: str, new: str) -> str:
    """The surrogate in the format of a mention."""
    if kind == "initial":
        return new.upper()
    if kind in NAME_KINDS:
        return new.upper() if raw.isupper() else "-".join(part.capitalize() for part in new.split("-"))
    if kind == "email":
        return "".join(n.upper() if r.isupper() else n for n, r in zip(new, raw, strict=True)) if len(new) == len(raw) else new
    if kind in ("ip", "secret"):
        return new
    letters = iter(new.replace("+", "") if kind == "phone" else new)
    return "".join(next(letters) if c.isalnum() else c for c in raw)


_FOUND = "rid long, kind string, entity string, start int, end int, head boolean"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (rid, kind, entity, start, end, head)
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for start, end, kind, entity, head in mentions(text or "")
        ]
        if rows:
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                names=["rid", "kind", "entity", "start", "end", "head"],
            )


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, attempts = (c.to_pylist() for c in batch.columns)
            new = [surrogate(key, k, e, a) for k, e, a in zip(kinds, entities, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "new"])

    return run


def draw_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, new) for distinct (kind, entity): no two share ``new``, none is an entity itself.

    All words of names count as one kind. Initials are a permutation already.
    """
    drawn = "kind string, entity string, attempt int, new string"
    table = materialise(entities.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(_drawn(key), drawn))
    while True:
        sort = F.when(F.col("kind").isin(*NAME_KINDS), "name").otherwise(F.col("kind")).alias("sort")
        each = table.where("kind <> 'initial'").select("*", sort)
        first = each.groupBy("sort", "new").agg(F.min(F.struct("entity", "kind")).alias("first"), F.count("*").alias("n"))
        shared = each.join(first.where("n > 1"), ["sort", "new"]).where("struct(entity, kind) <> first").select("kind", "entity")
        taken = each.join(entities.select(sort, F.col("entity").alias("new")), ["sort", "new"], "left_semi").select("kind", "entity")
        again = materialise(shared.union(taken).distinct())
        if again.isEmpty():
            return table.select("kind", "entity", "new")
        redrawn = table.join(again, ["kind", "entity"]).select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        table = materialise(
            table.join(again, ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "new")
            .union(redrawn.mapInArrow(_drawn(key), drawn))
        )


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = batch.column(1).to_pylist(), []
        for i, found in enumerate(batch.column(2).to_pylist()):
            counts.append(sum(m["head"] for m in found or ()))
            if found:
                text, parts, done = texts[i], [], 0
                for m in found:
                    parts += [text[done : m["start"]], render(m["kind"], text[m["start"] : m["end"]], m["new"])]
                    done = m["end"]
                texts[i] = "".join([*parts, text[done:]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["row", "text", "n_replaced"]
        )


def replace_personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs``, every row and column, with ``text`` rewritten and a column ``n_replaced``.

    Found are e-mail and IPv4 addresses, card numbers with a right check digit, phone
    numbers, access keys (AKIA, ASIA), the value after a word with token, secret, password, pwd,
    key or credential and = or : (16 or more characters of hex or base64, with letters and
    digits), IBANs, and names after one or more titles: all capitalised words
    that follow, with apostrophes and hyphens, initials and particles (van, de) between them.
    Each word has its own surrogate; titles, particles and a possessive 's stay. A name is
    one replacement. Null stays null; nulls, empty
    texts and texts without mentions have 0 replacements; rows equal in doc_id and text get
    the same text. A column that is already called n_replaced is replaced.
    """
    rid = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = materialise(docs.select(rid.alias("rid"), "text").mapInArrow(_find, _FOUND).distinct())
    named = found.join(materialise(resolved(found)), ["kind", "entity"], "left")
    found = materialise(named.withColumn("kind", F.coalesce("as_kind", "kind")).drop("as_kind"))
    entities = materialise(found.select("kind", "entity").distinct())
    new = draw_surrogates(entities, key)
    place = F.struct("start", "end", "kind", "new", "head")
    each = found.join(new, ["kind", "entity"]).groupBy("rid").agg(F.sort_array(F.collect_list(place)).alias("found"))
    rows = docs.select(rid.alias("rid"), F.struct("*").alias("row")).join(each, "rid", "left")
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.select("row", F.col("row.text").alias("_text"), "found").mapInArrow(_replace, f"row {kind}, text string, n_replaced long")
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_replaced"]
    return done.select(*columns, "n_replaced")
