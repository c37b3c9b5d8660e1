"""PII surrogates: detected entities get keyed replacements of the same kind, gender, script and format.

A surrogate is drawn from HMAC-SHA256(key, kind, canonical value, attempt), so every
task draws the same one and all mentions of an entity agree (coreference), however
a mention is laid out.  One Spark pass lists the distinct entities of the corpus;
two entities with one surrogate, or a surrogate that is itself an entity of the
corpus, draw again (distinctness).  What still collides after a few draws in a format
of digits gets free values of that format by rank, in a keyed order, and values with
more digits when it is full; secrets, names and mail grow as they are drawn again.
Only redrawn entities travel to the second pass.

Edge cases: a null text stays null, an empty one empty; texts without entities come
back unchanged; equal texts get equal results; other columns are not touched.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxhive.llm.common import running_total, set_aside, stage
from voxhive.session import BROADCAST_ROW_LIMIT

KEY = b"surrogate-key"
#: Draws for formats that cannot fill up (16 letters of a key, 11 and more places of an IBAN, four bytes of an address).
MAX_ATTEMPTS = 60
#: Draws of a format of digits before its values are dealt by rank; from EXACT on, an attempt is the number of a value.
DRAWS = 4
EXACT = 1 << 40
DIGIT_KINDS = ("phone", "card", "ssn")
#: The least digits of a phone number with its country code.
PHONE_DIGITS = 7

#: Titles that announce a name, by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "x": ("Dr", "Prof"),
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}

#: Vowels and consonants of scripts with both; other scripts stay in their own code block.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "greek": ("αεηιοω", "βγδζθκλμνξπρστφχψ"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
}
ENDINGS = {
    "latin": {"f": "a", "m": "o", "x": "e"}, "greek": {"f": "α", "m": "ος", "x": "ι"},
    "cyrillic": {"f": "а", "m": "й", "x": "и"},
}

PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]+@[^\W_][\w-]*(?:\.[^\W_](?:[\w-]*\w)?)+"),
    "cloud_key": re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "secret": re.compile(
        r"\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?((?=[^\s\"']*\d)[^\s\"']{8,})"
    ),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    "phone": re.compile(
        r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
        r"|(?<![\w(])\(\d{3}\)[ -]?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])"
    ),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
}
NAME = re.compile(
    r"\b(" + "|".join(sorted(GENDER, key=len, reverse=True)) + r")\b\.?[  ]"
    r"([^\W\d_][\w'’-]*(?:[  ][^\W\d_][\w'’-]*)?)"
)
DIGIT = re.compile(r"\d")


def digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def luhn(number: str) -> int:
    """Weighted digit sum modulo 10; 0 for a valid number."""
    total = 0
    for place, c in enumerate(reversed(number)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def canonical(kind: str, mention: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return digits(mention)
    if kind == "iban":
        return mention.replace(" ", "")
    return mention if kind in ("cloud_key", "secret", "ip") else mention.casefold()


def names(text: str) -> list[tuple[int, int, str]]:
    """Spans of names after a title, and of the same given names and surnames elsewhere in the text.

    A given name after a neutral title has the gender that another title gives it in
    the text; a word that is both a given name and a surname is a surname where no title tells.
    """
    titled, given, surnames = {}, {}, set()
    for m in NAME.finditer(text):
        parts = [p for p in re.finditer(r"[^  ]+", m.group(2)) if p.group()[0].isupper() or not p.group()[0].islower()]
        if not parts or parts[0].start():
            continue
        base, gender = m.start(2), GENDER[m.group(1)]
        if len(parts) == 2:
            titled[base + parts[0].start(), base + parts[0].end()] = gender
            if given.get(parts[0].group().casefold(), "x") == "x":
                given[parts[0].group().casefold()] = gender
        last = parts[-1]
        titled[base + last.start(), base + last.end()] = "surname"
        surnames.add(last.group().casefold())
    gender_of = lambda a, b, g: "given_" + (given[text[a:b].casefold()] if g == "x" else g)
    spans = [(a, b, k if k == "surname" else gender_of(a, b, k)) for (a, b), k in titled.items()]
    if titled:
        known = {text[a:b] for a, b in titled}
        known |= {k.upper() for k in known}
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=lambda k: (-len(k), k)))) + r")(?!\w)")
        for m in again.finditer(text):
            if m.span() not in titled:
                word = m.group().casefold()
                spans.append((*m.span(), "surname" if word in surnames else "given_" + given.get(word, "x")))
    return spans


def detect(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) in text order; of overlapping finds the earlier, then the longer one stays."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in PATTERNS["email"].finditer(text)]
    if DIGIT.search(text):
        for kind in ("cloud_key", "secret", "iban", "ssn", "ip", "phone", "card"):
            for m in PATTERNS[kind].finditer(text):
                at = 1 if kind == "secret" else 0
                value = m.group(at)
                if kind == "phone" and len(digits(value)) < PHONE_DIGITS:
                    continue
                if kind == "ip" and any(int(x) > 255 for x in value.split(".")) or kind == "iban" and not iban_valid(value):
                    continue
                found.append((m.start(at), m.end(at), kind))
    if any(title in text for title in GENDER):
        found += names(text)
    spans, end = [], 0
    for s in sorted(set(found), key=lambda s: (s[0], -s[1], s[2])):
        if s[0] >= end:
            spans.append(s)
            end = s[1]
    return spans


class Draw:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + b"\0%d" % self.block, "sha256")
            self.block += 1
        number, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return number % n

    def one(self, of: str) -> str:
        return of[self.below(len(of))]


def script_of(char: str) -> str | None:
    code = ord(char)
    if code < 0x250:
        return "latin"
    return "greek" if 0x370 <= code < 0x400 else "cyrillic" if 0x400 <= code < 0x530 else None


def like(char: str, draw: Draw) -> str:
    """A character of the same sort: digit, or letter of the same script and case."""
    if char.isdigit():
        return str(draw.below(10))
    if not char.isalpha():
        return char
    script = script_of(char)
    if script is None:
        block = [c for c in map(chr, range(ord(char) & ~63, (ord(char) | 63) + 1)) if c.isalpha()]
        return block[draw.below(len(block))]
    vowels, consonants = LETTERS[script]
    new = draw.one(vowels if char.casefold() in vowels else consonants)
    return new.upper() if char.isupper() else new


def new_name(kind: str, value: str, draw: Draw, attempt: int) -> str:
    script = script_of(value[0])
    if script is None:
        return "".join(like(c, draw) for c in value) + "".join(like(value[-1], draw) for _ in range(attempt // 4))
    vowels, consonants = LETTERS[script]
    body = "".join(draw.one(consonants) + draw.one(vowels) for _ in range(max(2, (len(value) - 1) // 2) + attempt // 4))
    if kind.startswith("given"):
        return body[:-1] + ENDINGS[script][kind[-1]]
    return body + draw.one(consonants)


def format_of(kind: str, value: str) -> str:
    """What a surrogate of digits keeps: first digit, length, a valid check digit."""
    return f"{kind} {value[0]} {len(value)} {int(kind == 'card' and luhn(value) == 0)}"


def numbered_value(form: str, number: int, key: bytes = KEY) -> str:
    """The value with that number in the keyed order of a format; numbers beyond it go on in the format with one more digit."""
    kind, first, length, valid = form.split()
    places = int(length) - 1 - int(valid)
    while number >= 10 ** places:
        number -= 10 ** places
        places += 1
    space, seed = 10 ** places, int.from_bytes(hmac.digest(key, f"{form} {places}".encode(), "sha256"), "big")
    step = 10 * (seed % (space // 10 or 1)) + (1, 3, 7, 9)[seed % 4]  # no factor 2 or 5: one to one
    new = first + (str((number * step + (seed >> 128)) % space).zfill(places) if places else "")
    return new + str(-luhn(new + "0") % 10) if int(valid) else new


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Replacement of a canonical value, itself canonical."""
    if attempt >= EXACT:
        return numbered_value(format_of(kind, value), attempt - EXACT, key)
    draw = Draw(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        place = Draw(key, "domain", domain, 0)  # mail of one domain stays together
        labels = ["".join(like(c, place) for c in label) for label in domain.split(".")[:-1]]
        more = str(draw.below(10 ** (1 + attempt // 4))) if attempt > 3 else ""  # short local parts run out of letters
        return "".join(like(c, draw) for c in local) + more + "@" + ".".join([*labels, "example"])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind in ("phone", "card", "ssn"):
        new = value[0] + "".join(like(c, draw) for c in value[1:])
        if kind == "card" and luhn(value) == 0:
            new = new[:-1] + "0"
            new = new[:-1] + str(-luhn(new) % 10)
        return new
    if kind == "cloud_key":
        return value[:4] + "".join(draw.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in value[4:])
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in value)
        more = "".join(draw.one("0123456789abcdef") for _ in range(attempt // 8))  # short secrets run out of letters
        return "".join(draw.one("0123456789abcdef") if hexadecimal else like(c, draw) for c in value) + more
    if kind == "iban":
        body = "".join(like(c, draw) for c in value[4:])
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    return new_name(kind, value, draw, attempt)


def lay_out(kind: str, mention: str, new: str) -> str:
    """Write a canonical surrogate the way the mention was written."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if mention.isupper() and any(c.isalpha() for c in mention):
        return new.upper()
    return new.capitalize() if kind.startswith(("given", "surname")) and mention[:1].isupper() else new


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, list[str]]:
    pieces, kinds, end = [], [], 0
    for start, stop, kind in detect(text):
        value = canonical(kind, text[start:stop])
        new = surrogate(kind, value, attempts.get((kind, value), 0), key)
        pieces += [text[end:start], lay_out(kind, text[start:stop], new)]
        kinds.append(kind)
        end = stop
    return "".join([*pieces, text[end:]]) if kinds else text, kinds


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, value) of all texts."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = {(k, canonical(k, t[a:b])) for t in frame["text"] if t for a, b, k in detect(t)}
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    return docs.select(F.col(text).alias("text")).mapInPandas(scan, "kind string, value string").distinct()


def dealt(bad: DataFrame, used: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, attempt, surrogate): a free value of its format for every (kind, value) of ``bad``; ``used`` (kind, surrogate) are taken.

    Of as many numbers as there are clashing and taken values of a kind and first digit, enough are free.
    """
    form = F.udf(format_of, "string")
    nth = F.udf(lambda f, i: numbered_value(f, i, key), "string")
    taken = used.where(F.col("kind").isin(*DIGIT_KINDS)).distinct()
    near = taken.groupBy(F.col("kind").alias("n_kind"), F.substring("surrogate", 1, 1).alias("n_first")).agg(F.count(F.lit(1)).alias("n"))
    one = stage(bad.select("kind", "value").withColumn("form", form("kind", "value")).withColumn("one", F.lit(1)), "clashing")
    need = one.groupBy("form", "kind", F.substring("value", 1, 1).alias("first")).agg(F.count(F.lit(1)).alias("m"))
    need = need.join(near, (F.col("kind") == F.col("n_kind")) & (F.col("first") == F.col("n_first")), "left")
    block = 10_000
    blocks = need.withColumn("size", F.col("m") + F.coalesce("n", F.lit(0))).select(
        "form", "kind", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block).cast("long"))).alias("b"))
    blocks = blocks.repartition("form", "b")
    numbers = blocks.select("form", "kind", F.explode(F.sequence(F.col("b") * block, F.least((F.col("b") + 1) * block, "size") - 1)).alias("j"))
    # formats that have grown into each other may deal one value twice: the next round finds it and sees it taken
    values = numbers.withColumn("surrogate", nth("form", "j"))
    free = stage(values.join(taken, ["kind", "surrogate"], "left_anti").select("form", "j", "surrogate", F.lit(1).alias("one")), "free")
    places = running_total(free, "form", ["j"], "one", "rank").select(F.col("form").alias("f"), F.col("rank").alias("r"), "j", "surrogate")
    ranked = running_total(one, "form", ["value"], "one", "rank")
    return ranked.join(places, (F.col("form") == F.col("f")) & (F.col("rank") == F.col("r"))).select(
        "kind", "value", (F.col("j") + EXACT).alias("attempt"), "surrogate")


def collision_free(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, attempt, surrogate) with one surrogate per entity, none of them an entity itself."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, int(a), key) for k, v, a in zip(kind, value, attempt)], dtype=object)

    drawn = lambda df: df.withColumn("surrogate", draw("kind", "value", "attempt"))
    rows = stage(drawn(found.withColumn("attempt", F.lit(0).cast("long"))), "entities")
    existing = found.select("kind", F.col("value").alias("surrogate"))
    for done in range(MAX_ATTEMPTS):
        first = rows.groupBy("kind", "surrogate").agg(
            F.min_by("value", F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("n")
        ).where("n > 1").drop("n")
        shared = rows.join(first, ["kind", "surrogate"]).where("value <> owner").select("kind", "value")
        real = rows.join(existing, ["kind", "surrogate"], "left_semi").select("kind", "value")
        bad = stage(shared.union(real).distinct().withColumn("again", F.lit(1)), "collisions")
        if bad.isEmpty():
            return rows
        marked = rows.join(bad, ["kind", "value"], "left")
        good = marked.where("again is null").select("kind", "value", "attempt", "surrogate")
        by_rank = F.col("kind").isin(*DIGIT_KINDS) & F.lit(done >= DRAWS)
        new = good.union(
            drawn(marked.where((F.col("again") == 1) & ~by_rank).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))))
        clashing = bad.where(by_rank)
        if done >= DRAWS and not clashing.isEmpty():
            new = new.union(dealt(clashing, existing.union(good.select("kind", "surrogate")), key))
        rows = stage(new, "entities")
    raise RuntimeError("surrogates still collide; the formats leave too little room")


def pseudonymise(docs: DataFrame, key: bytes = KEY, limit: int = BROADCAST_ROW_LIMIT, kinds: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; ``kinds`` names a column for the list of kinds found.

    Redrawn entities go to all tasks if they are at most ``limit``; else each document is joined with its own.
    """
    found = stage(entities(docs), "found")
    redrawn = stage(collision_free(found, key).where("attempt > 0").select("kind", "value", "attempt"), "redrawn")
    pairs = "array<struct<kind:string,value:string,attempt:long>>"
    rows, columns = set_aside(docs, "doc_id", "text")
    if redrawn.count() <= limit:
        common = {(r["kind"], r["value"]): r["attempt"] for r in redrawn.toLocalIterator()}
        source = rows.withColumn("own", F.lit(None).cast(pairs))
    else:
        common = {}

        @F.pandas_udf("array<struct<kind:string,value:string>>")
        def listed(texts: pd.Series) -> pd.Series:
            return pd.Series([
                [{"kind": k, "value": v} for k, v in sorted({(k, canonical(k, t[a:b])) for a, b, k in detect(t or "")})]
                for t in texts
            ])

        mine = rows.select("doc_id", F.explode(listed("text")).alias("e")).select("doc_id", "e.*").distinct()
        own = mine.join(redrawn, ["kind", "value"]).groupBy(F.col("doc_id").alias("id")).agg(
            F.collect_list(F.struct("kind", "value", "attempt")).alias("own")
        )
        source = rows.join(own, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")

    @F.pandas_udf("text string, kinds array<string>")
    def rewrite(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for t, extra in zip(texts, own):
            known = common
            if extra is not None and len(extra):
                known = {(e["kind"], e["value"]): e["attempt"] for e in extra}
            out.append(replaced(t, known, key) if t else (t, []))
        return pd.DataFrame(out, columns=["text", "kinds"])

    done = source.withColumn("new", rewrite("text", "own")).withColumn("text", F.col("new.text"))
    return done.select(*columns, *([F.col("new.kinds").alias(kinds)] if kinds else []))
