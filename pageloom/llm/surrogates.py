"""Surrogates for personal data: keyed, of the same kind and form, and distinct."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import slices, table
from pageloom.session import cut_lineage

LIMIT = 100
#: Session setting with the key of the registered query.
KEY_SETTING = "spark.pageloom.surrogateKey"

_EMAIL = re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_ADDRESS = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-]){0,3}\d{2,4}(?![\w-]*\w)")
_ABROAD = re.compile(r"(?<![\w.+-])\+\d(?:[ .-]?\d){6,14}(?![\w-]*\w)")
_NUMBER = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){8,18}(?![\w-]*\w)")
_TITLE = re.compile(r"\b(Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Dr|Prof|Г-н|Г-жа)\.? (?:(?:Dr|Prof)\.? )*"
                    r"([^\W\d_]+(?:[-'][^\W\d_]+)?)(?: ([^\W\d_]+(?:[-'][^\W\d_]+)?))?")

_MENTION = re.compile(r"(?<![^\W_])(?<![^\W_]-)[^\W\d_]+(?:-[^\W\d_]+|'(?!s\b)[^\W\d_]+)*(?!-?[^\W_])")

# Titles by gender, and the parts of which names are made, by script.
_ACADEMIC = {"Dr", "Prof"}
_FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"}
_NAMES = {
    "latin": (("Al", "Be", "Co", "Da", "El", "Fa", "Ga", "Ha", "Jo", "Ka", "Li", "Ma", "Ni", "Ro", "Sa", "To"),
              ("bri", "den", "lan", "mar", "nel", "ran", "ric", "ser", "vin", "wen"),
              {"f": ("a", "ia", "ine", "elle"), "m": ("o", "us", "ert", "as"), "n": ("i", "is", "en"), "s": ("er", "son", "mann", "ley", "ard")}),
    "cyrillic": (("Ал", "Бо", "Ва", "Да", "Ер", "Ива", "Ка", "Ма", "Ни", "Ро", "Се", "Та"),
                 ("бри", "дан", "лан", "мар", "нел", "ран", "сел", "тин", "вен"),
                 {"f": ("а", "ия", "ина"), "m": ("", "ий", "ей"), "n": ("и", "ли"), "s": ("ов", "ин", "енко", "ский")}),
}


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Endless keyed bytes for an entity."""
    count = 0
    while True:
        message = "\0".join(map(str, (*parts, count))).encode("utf-8", "surrogatepass")
        yield from hmac.new(key, message, hashlib.sha256).digest()
        count += 1


def script_of(word: str) -> str:
    if re.search(r"[Ѐ-ӿ]", word):
        return "cyrillic"
    return "latin" if re.fullmatch(r"[A-Za-zÀ-ɏ'-]+", word) else "other"


def form_of(kind: str) -> str:
    """What an entity is whatever its mention looks like: a telephone number may stand without separators, a name without a gender."""
    return "name" if kind.startswith("name") else "digits" if kind in ("phone", "number") else kind


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    form = form_of(kind)
    if form == "digits":
        return re.sub(r"\D", "", text)
    if form == "iban":
        return text.replace(" ", "")
    return text.lower() if form in ("email", "name") else text


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and canonical form of every entity; at overlaps the earlier kind of this list counts."""
    out: list[tuple[int, int, str, str]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y, _, _ in out)

    def add(kind: str, a: int, b: int) -> None:
        if b > a and free(a, b):
            out.append((a, b, kind, canonical(kind, text[a:b])))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", *m.span())
    if re.search(r"\d{2}", text):
        for m in _IBAN.finditer(text):
            add("iban", *m.span())
        for m in _ADDRESS.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add("ipv4", *m.span())
        for kind, pattern in (("phone", _PHONE), ("phone", _ABROAD), ("number", _NUMBER)):
            for m in pattern.finditer(text):
                if 7 <= sum(c.isdigit() for c in m[0]) <= 19:
                    add(kind, *m.span())
    names: dict[str, str] = {}
    for m in _TITLE.finditer(text):
        gender = "f" if m[1] in _FEMALE else "n" if m[1] in _ACADEMIC else "m"
        words = [i for i in (2, 3) if m[i] and m[i][0].isupper() and script_of(m[i]) != "other"]
        if words and words[0] == 2:
            for i in words:  # a lone word after a title is a family name
                kind, end = "name-s" if i == words[-1] else f"name-{gender}", m.end(i) - 2 * m[i].endswith("'s")
                add(kind, m.start(i), end)
                names.setdefault(canonical(kind, text[m.start(i):end]), kind)
    if names:  # further mentions, without a title
        taken = sorted((a, b) for a, b, _, _ in out)
        for m in _MENTION.finditer(text):
            if m[0][0].isupper() and (kind := names.get(canonical("name", m[0]))):
                at = bisect_left(taken, m.span())
                if (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or taken[at][0] >= m.end()):
                    out.append((*m.span(), kind, canonical(kind, m[0])))
    return sorted(out)


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """Replacement of an entity in canonical form; ``attempt`` picks another one, and a name's kind only its ending."""
    form = form_of(kind)
    bytes_ = _stream(key, form, entity, attempt)

    def digits(text: str) -> str:
        return "".join(str(next(bytes_) % 10) if c.isdigit() else c for c in text)

    if form == "email":
        name, _, domain = entity.partition("@")
        local = "".join(chr(97 + next(bytes_) % 26) if c.isalpha() else str(next(bytes_) % 10) if c.isdigit() else c
                        for c in name)
        if sum(c.isalnum() for c in local) < 10:  # short names collide
            local += "".join(chr(97 + next(bytes_) % 26) for _ in range(10 - sum(c.isalnum() for c in local)))
        return f"{local}@{''.join(chr(97 + next(bytes_) % 26) for _ in range(8))}.example.{'com' if domain.endswith('.com') else 'org'}"
    if form == "ipv4":
        return f"{1 + next(bytes_) % 223}." + ".".join(str(next(bytes_)) for _ in range(3))
    if form == "iban":
        body = "".join(str(next(bytes_) % 10) if c.isdigit() else chr(65 + next(bytes_) % 26) for c in entity[4:])
        value = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - value % 97:02d}{body}"  # with right check digits
    if form == "digits":
        out = digits(entity)
        if len(entity) >= 12 and luhn(entity):
            return next(out[:-1] + last for last in "0123456789" if luhn(out[:-1] + last))
        return out
    starts, middles, ends = _NAMES[script_of(entity)]
    pick = lambda xs: xs[next(bytes_) % len(xs)]
    return (pick(starts) + "".join(pick(middles) for _ in range(1 + attempt)) + pick(ends[kind[-1]])).lower()


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def in_form(kind: str, mention: str, value: str) -> str:
    """Write a surrogate in the form of the mention: its separators, spaces and capitals."""
    if kind in ("phone", "number", "iban"):
        it = iter(value)
        return "".join(next(it, "") if c.isalnum() else c for c in mention)
    if kind.startswith("name"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value.capitalize()
    if kind == "email" and mention.isupper():
        return value.upper()
    return value


_ENTITY = pa.struct([("form", pa.string()), ("kind", pa.string()), ("entity", pa.string())])


def mentioned(docs: DataFrame) -> DataFrame:
    """Distinct entities of the different texts, as (digest of the text, form, kind, entity)."""
    schema = pa.schema([("digest", pa.int64()), ("found", pa.list_(_ENTITY))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[{"form": form_of(k), "kind": k, "entity": e} for k, e in sorted({(k, e) for *_, k, e in entities(t or "")})]
                     for t in part.column("text").to_pylist()]
            some = pa.array([bool(f) for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("digest").filter(some), pa.array([f for f in found if f], pa.list_(_ENTITY))], schema=schema)

    return (docs.select(F.xxhash64("text").alias("digest"), "text")
            .mapInArrow(scan, "digest long, found array<struct<form:string,kind:string,entity:string>>")
            .select("digest", F.inline("found")).distinct())


def resolved(found: DataFrame) -> DataFrame:
    """Entities of the corpus, one row each: ``form``, ``entity``, the ``kind`` that shapes them, and whether texts ``differ`` in it.

    A name is shaped by the gender that more texts give it (female at ties), else as a given name, else as a family name.
    """
    def texts(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1))

    counted = found.groupBy("form", "entity").agg(
        texts("name-f").alias("f"), texts("name-m").alias("m"), texts("name-n").alias("n"),
        F.min("kind").alias("least"), F.max("kind").alias("most"))
    name = (F.when((F.col("f") > 0) & (F.col("f") >= F.col("m")), "name-f").when(F.col("m") > 0, "name-m")
            .when(F.col("n") > 0, "name-n").otherwise("name-s"))
    return counted.select("form", "entity", F.when(F.col("form") == "name", name).otherwise(F.col("least")).alias("kind"),
                          ((F.col("form") == "name") & (F.col("least") != F.col("most"))).alias("differ"))


def assign(distinct: DataFrame, key: bytes) -> DataFrame:
    """Entities (form, entity) that need an ``attempt`` other than the first, so that surrogates are distinct.

    Surrogates are made from the key. One that several entities of a form would get, or that is itself an entity of that form,
    is left to the smallest entity (in the second case to none); only the others go into the next round, where they are held against
    each other, all settled surrogates and all entities. Names come from short lists, so only their full surrogate counts, and each
    attempt adds a syllable, so there are ten times as many (nine in Cyrillic). Entities are grouped by surrogate with
    partial aggregation; a round that finds no collision is the last. Numbers keep their length: if one length
    has more entities than free values, that is an error after ``LIMIT`` rounds, never a shared surrogate.
    """
    @F.pandas_udf("string")
    def made(kind, entity, attempt):
        import pandas as pd

        return pd.Series([surrogate(k, e, int(a), key) for k, e, a in zip(kind, entity, attempt)])

    real = distinct.select("form", F.col("entity").alias("value"))
    taken, settled = real, []
    now = distinct.select("form", "kind", "entity")
    for attempt in range(LIMIT):
        tried = cut_lineage(now.withColumn("value", made("kind", "entity", F.lit(attempt))), "surrogates")
        alone = tried.groupBy("form", "value").agg(F.min("entity").alias("keeper"), F.count("*").alias("n"))
        free = alone.join(taken, ["form", "value"], "left_anti")
        kept = cut_lineage(free.select("form", "value", F.col("keeper").alias("entity")), "surrogates")
        if attempt:
            settled.append(kept.select("form", "entity", F.lit(attempt).alias("attempt")))
        now = cut_lineage(tried.join(kept, ["form", "entity"], "left_anti").select("form", "kind", "entity"), "surrogates")
        if now.isEmpty():
            break
        taken = taken.unionAll(kept.select("form", "value"))
    else:
        raise ValueError(f"surrogates still collide after {LIMIT} rounds: too few values of some form for its entities")
    if not settled:
        return distinct.select("form", "entity", F.lit(0).alias("attempt")).limit(0)
    return cut_lineage(reduce(DataFrame.unionAll, settled), "surrogates")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id``, ``text`` with surrogates, and ``n_entities`` of every row.

    E-mail and IPv4 addresses, IBANs, telephone and long numbers are found by form, and personal names by
    their title; further capitalised whole words equal to a name found in the same text are mentions of it. An entity is its
    canonical form: digits without separators, names without case, title or gender. Its surrogate is derived from the secret
    ``key`` and that form, so all mentions, in any document and writing, get the same one; it keeps kind, separators,
    capitals, script, the check digits of numbers that have them, and a name's gender, if any text of the corpus tells it.
    Collisions are searched over the distinct entities of the whole corpus; only entities that try again, or whose texts
    differ in their gender, are joined to the texts that mention them.

    Null text stays null with no entity; empty text stays empty. Rows are treated one by one, repeated rows and very long texts too;
    other columns are ignored; an empty table gives no rows.
    """
    found = cut_lineage(mentioned(docs), "entities")
    known = cut_lineage(resolved(found), "entities")
    again = assign(known.select("form", "entity", "kind"), key)
    odd = known.join(again, ["form", "entity"], "left").where("differ OR attempt IS NOT NULL").select(
        "form", "entity", F.col("kind").alias("as"), F.coalesce("attempt", F.lit(0)).alias("attempt"))
    odd = cut_lineage(odd, "entities")
    special = cut_lineage(
        found.select("digest", "form", "entity").distinct().join(odd, ["form", "entity"]).groupBy("digest")
        .agg(F.collect_list(F.struct("form", "entity", "as", "attempt")).alias("again")), "entities")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, counts = [], []
            for text, more in zip(part.column("text").to_pylist(), part.column("again").to_pylist()):
                others = {(x["form"], x["entity"]): (x["as"], x["attempt"]) for x in more or ()}
                pieces, at, spans = [], 0, entities(text or "")
                for a, b, kind, entity in spans:
                    shape, attempt = others.get((form_of(kind), entity), (kind, 0))
                    pieces += [text[at:a], in_form(kind, text[a:b], surrogate(shape, entity, attempt, key))]
                    at = b
                texts.append(text if text is None else "".join(pieces) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(special, "digest", "left")
    return rows.select("doc_id", "text", "again").mapInArrow(rewrite, "doc_id long, text string, n_entities long")


def replaced_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogates under the key of the session (``KEY_SETTING``); without one, under a new key that nobody keeps."""
    key = spark.conf.get(KEY_SETTING, None)
    return replace_entities(table(spark, folder, "documents"), key.encode() if key else secrets.token_bytes(32))
