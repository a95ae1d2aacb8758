"""Personal data: fixed patterns, and information-theoretic sanitisation around them.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; they
are the protected entities.  A term can give an entity away without being one: the
corpus tells how strongly.  For each entity the other terms of its texts are
counted; with n documents, n(e) holding the entity, n(t) the term and n(t, e)
different texts with both,

    PMI(t, e) = log(n n(t, e) / (n(t) n(e)))      IC(e) = log(n / n(e))

A term whose PMI reaches ``generalise`` times IC discloses the entity and is
generalised at all its places in the entity's texts; from ``remove`` times IC on it
is removed.  One text is enough to be judged: n(t) tells a rare name from a common
word.  A term is generalised to its kind of word, as its writing tells it: NAME for a
capitalised word, ACRONYM for one in capitals, else TERM.

Scale: a text with an entity is kept once, with its distinct entities and the number
of its rows.  Entities that stand in exactly the same texts are judged as one, so a
list of addresses doesn't multiply its words.  Since n(t, e) is at most n(e), only
terms with n(t) up to n(e)^g n^(1 - g) can disclose an entity (g is ``generalise``);
others are dropped before they meet the entities, and this drops no disclosing term.
n(t) is counted over all documents, but only for terms that a bounded Bloom filter of
the candidates lets pass (exact counts follow from a join).  Spans found for a text
are joined back by its MD5, only to rows that hold an entity.  n(t, e) counts distinct
texts, n(e) and n(t) rows, so that copies of one text give no support to each other:
a text of c rows alone with its entity and a term of its own has the strength
log(n / c^2) / log(n / c).

Defined results: a null text counts as empty and has no spans.  A very long text is
searched whole, in time proportional to its length.  Repeated rows get the same spans;
strengths that tie with a threshold reach it.  Empty tables give empty results.
``personal_data`` carries only ``keep``; ``sanitise`` carries every column, and names its
own so that they clash with none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._bloom import build_bloom, may_contain
from paperloom.llm._shared import Scratch
from paperloom.llm._words import slices, strings

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit only: later ones cannot match if that one doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Disclosure:
    generalise: float = 0.8
    remove: float = 0.95


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time proportional to the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, by kind as listed and then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def entity_of(kind: str, value: str) -> str:
    """What makes two places the same entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def context_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside of all places."""
    starts, ends = _covered(spans)
    for m in _TERM.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # of disjoint intervals the last that starts before the word's end reaches farthest
        if not before or ends[before - 1] <= a:
            yield m[0].lower(), a, b


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that the places cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, entities) of the texts with an entity."""
    for batch in batches:
        for part in slices(batch, "__text"):
            texts = [(t, s) for t in strings(part, "__text") if (s := find_spans(t))]
            if texts:
                entities = [sorted({entity_of(k, t[a:b]) for k, a, b in s}) for t, s in texts]
                columns = [pa.array([text_key(t) for t, _ in texts], pa.binary()), pa.array([t for t, _ in texts], pa.string()), pa.array(entities, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "__text", "entities"])


def _text_terms(batches: Iterator[pa.RecordBatch], shared=None) -> Iterator[pa.RecordBatch]:
    """(text_key, term) of the distinct terms of each text, of those that the filter lets pass."""
    for batch in batches:
        for part in slices(batch, "__text"):
            for key, text in zip(part.column("text_key").to_pylist(), strings(part, "__text"), strict=True):
                terms = sorted({t for t, _, _ in context_terms(text, find_spans(text))})
                if shared is not None and terms:
                    hit = may_contain(shared.value, np.array([_term_id(t) for t in terms], np.uint64))
                    terms = [t for t, h in zip(terms, hit.tolist(), strict=True) if h]
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.binary()), pa.array(terms, pa.string())], names=["text_key", "term"])


_PLACES = "array<struct<start:long,end:long,removed:boolean>>"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, terms): all places of each text's disclosing terms."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())]))
    for batch in batches:
        for part in slices(batch, "__text"):
            found = []
            for text, strong in zip(strings(part, "__text"), part.column("strong").to_pylist(), strict=True):
                removed = {x["term"]: x["removed"] for x in strong}
                found.append([{"start": a, "end": b, "removed": removed[t]} for t, a, b in context_terms(text, find_spans(text)) if t in removed])
            yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array(found, kind)], names=["text_key", "terms"])


def _term_id(term: str) -> int:
    """Spark's xxhash64 of the term, so that filters are built from a column."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)


def _term_counts(batches: Iterator[pa.RecordBatch], shared, flush: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(term, number of texts) of the terms that the filter lets pass."""
    counts: dict[str, int] = {}

    def passing() -> pa.RecordBatch:
        terms = list(counts)
        hit = may_contain(shared.value, np.array([_term_id(t) for t in terms], np.uint64))
        kept = [t for t, h in zip(terms, hit.tolist(), strict=True) if h]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([counts[t] for t in kept], pa.int64())], names=["term", "n"])

    for batch in batches:
        for part in slices(batch, "__text"):
            for text in strings(part, "__text"):
                if text:
                    for term in {w.lower() for w in set(_TERM.findall(text))}:
                        counts[term] = counts.get(term, 0) + 1
            if len(counts) >= flush:
                yield passing()
                counts.clear()
    if counts:
        yield passing()


def disclosing_terms(df: DataFrame, text: str = "text", limits: Disclosure = Disclosure(), scratch: Scratch | None = None) -> DataFrame:
    """(text_key, terms) with the terms array<struct<start, end, removed>> that disclose an entity of the text."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    texts = df.select(F.col(text).alias("__text"))
    held = texts.mapInArrow(_held_rows, "text_key binary, __text string, entities array<string>")
    # of copies of a text one is kept, with the number of its rows
    held = scratch.keep(held.groupBy("text_key").agg(F.first("__text").alias("__text"), F.first("entities").alias("entities"), F.count("*").alias("copies")), "held")
    total = float(df.count())
    own = held.select("text_key", "copies", F.explode("entities").alias("entity"))
    # the texts of an entity, by their number and 128 bits: entities with the same texts are one class
    same = [F.bit_xor(F.xxhash64("text_key", F.lit(i))) for i in range(2)]
    entities = own.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("m"), *[x.alias(f"x{i}") for i, x in enumerate(same)])
    entities = scratch.keep(entities.where(F.col("n_e") < total), "entities", narrow=True)
    classes = scratch.keep(own.join(entities, "entity").select("text_key", "n_e", "m", "x0", "x1").distinct(), "classes", narrow=True)
    most = classes.agg(F.max("n_e")).first()[0]
    none = spark.createDataFrame([], f"text_key binary, terms {_PLACES}")
    if most is None:
        return none
    pairs = "text_key binary, term string"
    terms = scratch.keep(held.select("__text", "text_key").mapInArrow(_text_terms, pairs).select("term").distinct(), "words", narrow=True)
    n_terms = terms.count()
    if not n_terms:
        return none

    def ceiling(n_e: Column) -> Column:
        """The most documents that a disclosing term of an entity can stand in (with room for rounding)."""
        return F.pow(n_e, F.lit(limits.generalise)) * F.pow(F.lit(total), F.lit(1 - limits.generalise)) * (1 + 1e-9)

    bloom = spark.sparkContext.broadcast(build_bloom(terms.select(F.xxhash64("term").alias("id")), n_terms))
    counted = texts.mapInArrow(partial(_term_counts, shared=bloom), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    rare = scratch.keep(counted.where(F.col("n_t") <= ceiling(F.lit(most))), "rare", narrow=True)
    n_rare = rare.count()
    if not n_rare:
        return none
    passing = spark.sparkContext.broadcast(build_bloom(rare.select(F.xxhash64("term").alias("id")), n_rare))
    near = held.select("__text", "text_key").mapInArrow(partial(_text_terms, shared=passing), pairs).join(rare, "term")
    near = near.join(classes, "text_key").where(F.col("n_t") <= ceiling(F.col("n_e")))
    near = scratch.keep(near, "near", narrow=True)
    key = ["term", "m", "x0", "x1"]
    strength = F.log(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(total) / F.col("n_e"))
    strong = near.groupBy(*key).agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).withColumn("strength", strength)
    strong = scratch.keep(strong.where(F.col("strength") >= limits.generalise).select(*key, (F.col("strength") >= limits.remove).alias("removed")), "strong", narrow=True)
    marked = near.join(strong, key).groupBy("text_key", "term").agg(F.max("removed").alias("removed"))
    # a text's terms are at most its own words
    marked = marked.groupBy("text_key").agg(F.collect_list(F.struct("term", "removed")).alias("strong"))
    found = held.select("text_key", "__text").join(marked, "text_key").mapInArrow(_places, f"text_key binary, terms {_PLACES}")
    found = scratch.keep(found, "terms", narrow=True)
    scratch.drop("held", "entities", "classes", "words", "rare", "near", "strong")
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            texts = strings(part, "__text")
            found = [find_spans(t) for t in texts]
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in found], pa.int64()) for kind in KINDS]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in found]
            marks = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
            keys = [text_key(t) if s else None for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *counts, pa.array(marks, pa.string()), pa.array(joined, pa.string()), pa.array(keys, pa.binary())],
                names=[*part.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base_sha256", "__base", "__key"],
            )


def personal_data(df: DataFrame, keep: list[str], text: str = "text", limits: Disclosure = Disclosure()) -> DataFrame:
    """The ``keep`` columns of every row with counts by kind, base_sha256, and all spans (``kind:start:end``)."""
    scratch = Scratch(df.sparkSession, "pii")
    terms = disclosing_terms(df, text, limits, scratch)
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long", False)
    digests = scratch.keep(rows.mapInArrow(_digests, schema.add("base_sha256", "string").add("__base", "string").add("__key", "binary")), "digests", narrow=True)
    plain = digests.where(F.col("__key").isNull()).withColumns({"spans": F.col("__base"), "n_term": F.lit(0).cast("long")})
    listed = F.coalesce(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))), F.array().cast("array<string>"))
    marked = digests.where(F.col("__key").isNotNull()).join(terms.withColumnRenamed("text_key", "__key"), "__key", "left")
    marked = marked.withColumns({"spans": F.array_join(F.concat(F.array("__base"), listed), ","), "n_term": F.size(listed).cast("long")})
    columns = [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"]
    return plain.select(*columns).unionByName(marked.select(*columns))


def general(word: str) -> str:
    """What a disclosing term is generalised to."""
    return "<ACRONYM>" if word.isupper() else "<NAME>" if word[0].isupper() else "<TERM>"


def mask(text: str, spans: list[tuple[str, int, int]], terms: list[dict] | None) -> str:
    """The text with places named by kind, generalised terms as their kind of word, and removed terms left out."""
    cuts = sorted([(a, b, f"<{k.upper()}>") for k, a, b in spans] + [(t["start"], t["end"], "" if t["removed"] else general(text[t["start"] : t["end"]])) for t in terms or []])
    out, at = [], 0
    for a, b, name in cuts:
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)  # of places that overlap the first is named, and all are covered
    return "".join([*out, text[at:]])


def _split(batches: Iterator[pa.RecordBatch], text: str, key: str | None) -> Iterator[pa.RecordBatch]:
    """The rows with an entity, with their text's key as the column ``key``; without that name, the other rows."""
    for batch in batches:
        for part in slices(batch, text):
            texts = strings(part, text)
            own = [bool(find_spans(t)) for t in texts]
            if key:
                part = part.append_column(key, pa.array([text_key(t) if o else None for t, o in zip(texts, own, strict=True)], pa.binary()))
            yield part.filter(pa.array([o == bool(key) for o in own], pa.bool_()))


def _masked(batches: Iterator[pa.RecordBatch], text: str, terms: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            texts = [mask(t, find_spans(t), x) for t, x in zip(strings(part, text), part.column(terms).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if n == text else part.column(n) for n in part.schema.names if n != terms]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in part.schema.names if n != terms])


def sanitise(df: DataFrame, text: str = "text", limits: Disclosure = Disclosure()) -> DataFrame:
    """All rows and columns of ``df``, the text without personal data and disclosing terms."""
    scratch = Scratch(df.sparkSession, "pii")
    terms = disclosing_terms(df, text, limits, scratch)
    taken = {c.lower() for c in df.columns}
    key, own = (next(n for i in count() if (n := f"__{name}{i}") not in taken) for name in ("key", "terms"))
    plain = df.mapInArrow(partial(_split, text=text, key=None), df.schema)
    keyed = T.StructType([*df.schema.fields, T.StructField(key, T.BinaryType())])
    touched = df.mapInArrow(partial(_split, text=text, key=key), keyed)
    # merged, so that a task has one Python worker: finding the rows and masking them stand on two sides of an exchange
    joined = touched.join(terms.select(F.col("text_key").alias(key), F.col("terms").alias(own)).hint("merge"), key, "left").select(*df.columns, own)
    return plain.unionByName(joined.mapInArrow(partial(_masked, text=text, terms=own), df.schema))
