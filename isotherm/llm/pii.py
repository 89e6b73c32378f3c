"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

The protected entities are the values that the base patterns find, and what several values have in common: the
domain of an address, the /24 network of an ip, the issuer digits of a card, the prefix of a phone number (``levels``).
A term t in a text with an entity e discloses it if the pointwise mutual information
``log2(n_et N / (n_e n_t))`` reaches ``ALPHA`` of the entity's information
content ``log2(N / n_e)``: then whoever reads t has learnt that share of e.
All four count different texts: N all of them, n_e, n_t and n_et those with the entity, the term
(outside of base spans) and both, anywhere in the text.  Copies of one text are no evidence.
There is no least count, neither of texts nor of letters: n_et must be more than chance gives, that is, the
Hoeffding bound of P(X >= n_et) for n_e draws must not exceed ``LEVEL``; an entity seen once is
decided as soon as N is some hundreds.  Every occurrence of a disclosing term in any document
is a span of kind ``term``.  ``sanitise`` generalises a value to what it has in common with others
where that alone gives away less than ``ALPHA`` of it, else to the name of its kind; terms become ``<TERM>``, or all is removed.

Base patterns run in time linear in the text, long runs included.  Positions
are code points, ends exclusive.  Null text counts as empty.  Rows that repeat an id get rows of
their own.  Extra columns are ignored.  Terms are looked for in the corpus through a bitmap of
at most 32 MB; what passes is joined with the terms themselves, by a broadcast below
``store.BROADCAST_ROWS`` terms and a shuffle beyond.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import small, stage

#: fixed values: kinds as listed, and the patterns
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

ALPHA = 0.8
LEVEL = 0.01
#: bits of the largest bitmap, places gathered in one row, terms a task holds before it passes them on
MOST_BITS = 1 << 28
PIECE = 1 << 16
FLUSH = 200_000


# ---- base patterns ---------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match starts where the run of local characters before an ``@`` starts, or where the last match ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


# ---- words --------------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+")
#: the same letters among the first 256 characters: a set of so few is looked up faster than a category
NARROW = re.compile("[" + "".join(re.escape(chr(i)) for i in range(256) if WORD.match(chr(i))) + "]+")
TEXTS = "digest string, entities array<string>, terms array<string>"
#: digits of a card that name its issuer, and of a phone number its country and area
ISSUER, PREFIX = 6, 5
DISCLOSING = "entity string, term string, n_e long, n_t long, n_et long, share double"
FOUND = "row long, doc_id long, counts array<long>, base string, hits array<struct<term:string,start:int,stop:int>>, text string"


def levels(kind: int, value: str) -> tuple[str, str]:
    """The entity of a base span, written alike however it was spelled, and the wider one it belongs to."""
    name = KINDS[kind]
    if name == "email":
        value = value.lower()
        return f"email:{value}", f"email:*@{value.rsplit('@', 1)[1]}"
    if name == "ip":
        parts = [str(int(p)) for p in value.split(".")]
        return f"ip:{'.'.join(parts)}", f"ip:{'.'.join(parts[:3])}.*"
    digits = "".join(c for c in value if c in "0123456789")
    return (f"card:{digits}", f"card:{digits[:ISSUER]}*") if name == "card" else (f"phone:+{digits}", f"phone:+{digits[:PREFIX]}*")


def words_of(text: str) -> re.Pattern[str]:
    """The pattern that finds the words of ``text``, and the same words as ``WORD`` does."""
    try:
        if not text.isascii():
            text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD
    return NARROW


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Every word in lower case with its place, but those that touch a base span."""
    at, reach = 0, -1
    for m in words_of(text).finditer(text):
        # spans are sorted by start; ``reach`` is the furthest end of those that start before the word ends
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach:
            yield m[0].lower(), m.start(), m.end()


def word_set(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The different words of ``free_words``."""
    return {w for w, _, _ in free_words(text, spans)} if spans else {w.lower() for w in set(words_of(text).findall(text))}


def bits_of(terms: DataFrame, size: int) -> tuple[Broadcast, int]:
    """A bitmap of the CRC of each term, at most ``MOST_BITS`` long: what it lets pass is joined with ``terms`` itself."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * size).bit_length()))
    place = F.crc32(F.encode("term", "UTF-8")) % bits
    out = bytearray(bits // 8)
    for piece in terms.groupBy((place / PIECE).cast("int").alias("at")).agg(F.collect_set((place % PIECE).cast("int")).alias("set")).toLocalIterator():
        held = np.zeros(PIECE, dtype=bool)
        held[piece["set"]] = True
        out[piece["at"] * PIECE // 8 : (piece["at"] + 1) * PIECE // 8] = np.packbits(held, bitorder="little").tobytes()
    return terms.sparkSession.sparkContext.broadcast(bytes(out)), bits - 1


def passing(terms: set[str], held: bytes, mask: int) -> set[str]:
    """The terms whose bit is set."""
    crc = zlib.crc32
    return {t for t in terms if held[(place := crc(t.encode("utf-8", "replace")) & mask) >> 3] >> (place & 7) & 1}


# ---- terms ---------------------------------------------------------------------------


def entity_texts(texts: DataFrame) -> DataFrame:
    """Each different text with entities: its entities and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.string()), ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py()
                spans = base_spans(text)
                if spans:
                    digest = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                    rows.append({"digest": digest, "entities": list({x for s, k, e in spans for x in levels(k, text[s:e])}), "terms": list(word_set(text, spans))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.select("text").mapInArrow(run, TEXTS).dropDuplicates(["digest"])


def term_counts(texts: DataFrame, copies: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``term, n_t``: different texts with the term, over the whole corpus; a text with k copies counts 1 / k each time."""
    held, mask = bits_of(wanted, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, float] = {}
        bitmap = held.value
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["term", "n"])
        for batch in batches:
            for value, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = value.as_py()
                for w in passing(word_set(text, base_spans(text)), bitmap, mask):
                    sums[w] = sums.get(w, 0.0) + 1 / k
            if len(sums) > FLUSH:
                yield flush()
                sums.clear()
        yield flush()

    weighed = texts.join(small(copies), "h", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    counts = weighed.mapInArrow(run, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n_t"))
    return counts.join(small(wanted, size), "term", "left_semi")


def beyond_chance(total: Column, level: float) -> Column:
    """Whether n_et is more than n_e draws out of ``total`` give by chance (Hoeffding's bound of the hypergeometric tail)."""
    f, q = F.col("n_et") / F.col("n_e"), F.greatest("n_t", "n_et") / total
    missed = F.when(f < 1, (1 - f) * F.log((1 - f) / (1 - q))).otherwise(0.0)
    return (f > q) & (-F.col("n_e") * (f * F.log(f / q) + missed) <= math.log(level))


@dataclass
class Study:
    """What the corpus says of its entities: stage tables, and the number of different texts."""

    texts: DataFrame
    different: DataFrame
    seen: DataFrame
    named: DataFrame
    total: int


def study(docs: DataFrame, text_col: str = "text") -> Study:
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    different = stage(texts.groupBy("h").agg(F.count("*").alias("copies")), "different")
    seen = stage(entity_texts(texts), "seen")
    named = seen.select("digest", F.explode("entities").alias("entity"))
    per = named.groupBy("entity").agg(F.count("*").alias("n_e"))
    return Study(texts, different, seen, stage(named.join(per, "entity"), "named"), different.count())


def disclosing(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, level: float = LEVEL, known: Study | None = None) -> DataFrame:
    """``entity, term, n_e, n_t, n_et, share``: the share of the entity's information that the term gives away."""
    s = known or study(docs, text_col)
    texts, different, seen, named, total = s.texts, s.different, s.seen, s.named, F.lit(s.total).cast("double")
    # a pair can only reach alpha if n_t <= n_et (N / n_e) ** (1 - alpha), and n_et <= n_e; the
    # texts with any entity that hold the term are a lower bound of n_t, known already
    most = F.col("n_e") * F.pow(total / F.col("n_e"), F.lit(1 - alpha)) * (1 + 1e-9)
    caps = named.groupBy("digest").agg(F.max(most).alias("cap"))
    words = seen.join(caps, "digest").select("digest", "cap", F.explode("terms").alias("term"))
    near = words.groupBy("term").agg(F.count("*").alias("n_near"), F.max("cap").alias("cap"))
    wanted = stage(near.where("n_near <= cap").select("term"), "wanted")
    size = wanted.count()
    if not size:
        return named.sparkSession.createDataFrame([], DISCLOSING)
    counts = stage(term_counts(texts, different.where("copies > 1"), wanted, size), "counts")
    rare = words.join(small(counts, size), "term").where("n_t <= cap").select("digest", "term", "n_t")
    pairs = rare.join(named, "digest").where(F.col("n_t") <= most).groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    known = F.log2(total / F.col("n_e"))
    shared = F.log2(F.col("n_et") * total / (F.col("n_e") * F.greatest("n_t", "n_et")))
    return pairs.where(known > 0).withColumn("share", shared / known).where((F.col("share") >= alpha) & beyond_chance(total, level)).select("entity", "term", "n_e", F.col("n_t").cast("long").alias("n_t"), "n_et", "share")


def find_base(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, size: int, texts: bool) -> DataFrame:
    """A row per document; ``hits`` are its words that the bitmap of ``terms`` lets pass."""
    held, mask = bits_of(terms, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.struct([("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("base", pa.string()), ("hits", pa.list_(hit)), ("text", pa.string())])
        number = TaskContext.get().partitionId() << 33
        bitmap = held.value
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                spans = base_spans(text)
                counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
                near = passing(word_set(text, spans), bitmap, mask) if size else ()
                hits = [{"term": w, "start": s, "stop": e} for w, s, e in free_words(text, spans) if w in near] if near else []
                rows.append({"row": number, "doc_id": key, "counts": counts, "base": ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans), "hits": hits, "text": text if texts else None})
                number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, known: Study | None = None) -> DataFrame:
    """Per row: ``doc_id``, counts by kind, ``base`` and ``spans``, and, with ``texts``, ``row`` (a number of its own) and ``text``."""
    marked = stage(disclosing(docs, text_col, known=known).select("term").distinct(), "terms")
    size = marked.count()
    found = stage(find_base(docs, id_col, text_col, marked, size, texts), "personal")
    near = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("t")).select("row", "t.*")
    terms = near.join(small(marked, size), "term", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("extra"))
    both = found.join(terms, "row", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    # "kind:start:end" to sortable structs, the added ones beside them
    parsed = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(order, F.split(x, ":")[0]).cast("int").alias("kind"), F.split(x, ":")[2].cast("int").alias("stop")),
    )
    added = F.transform(F.col("extra"), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["stop"].alias("stop")))
    every = F.array_sort(F.concat(parsed, added))
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(order, s["kind"]), s["start"], s["stop"])), ","))
    return both.select("doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], "base", spans.alias("spans"), *(["row", "text"] if texts else []))


def personal_digests(docs: DataFrame) -> DataFrame:
    found = find_personal(docs)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def safe_levels(named: DataFrame, total: int, alpha: float = ALPHA) -> DataFrame:
    """``value, general``: values whose wider entity gives away less than ``alpha`` of them.  Every text with the value has the wider one, so its share is log(N / n_general) / log(N / n_value)."""
    per = named.select("entity", "n_e").distinct()
    value = per.where(~F.col("entity").contains("*")).withColumn("kind", F.substring_index("entity", ":", 1)).withColumn("own", F.expr("substring(entity, length(kind) + 2)"))
    wide = (
        F.when(F.col("kind") == "email", F.concat(F.lit("email:*@"), F.substring_index("own", "@", -1)))
        .when(F.col("kind") == "ip", F.concat(F.lit("ip:"), F.substring_index("own", ".", 3), F.lit(".*")))
        .when(F.col("kind") == "card", F.concat(F.lit("card:"), F.substring("own", 1, ISSUER), F.lit("*")))
        .otherwise(F.concat(F.lit("phone:"), F.substring("own", 1, PREFIX + 1), F.lit("*")))
    )
    pairs = value.select(F.col("entity").alias("value"), F.col("n_e").alias("n_value"), wide.alias("entity")).join(per, "entity")
    n = F.lit(float(total))
    share = F.log2(n / F.col("n_e")) / F.log2(n / F.col("n_value"))
    return pairs.where((F.col("n_value") < total) & (share < alpha)).select("value", F.col("entity").alias("general"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", general: bool = True) -> DataFrame:
    """``doc_id, text``: spans generalised, or removed; what overlaps is replaced as one, by the first kind."""
    known = study(docs, text_col)
    found = stage(find_personal(docs, id_col, text_col, texts=True, known=known), "found")
    safe = safe_levels(known.named, known.total)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, f"{KINDS[kind]}:{start}", levels(kind, text[start:stop])[0]) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for start, kind, stop in base_spans(text)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["row", "at", "value"])

    named = found.where("base <> ''").select("row", "text").mapInArrow(values, "row long, at string, value string")
    # spans of one kind never start at one place
    names = named.join(safe, "value").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("at", "general"))).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, wider in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                wider = dict(wider or ())
                done, at = [], 0
                for kind, start, stop in (x.split(":") for x in spans.split(",") if x):
                    if int(start) >= at:
                        name = wider.get(f"{kind}:{start}", kind).split(":", 1)
                        done += [text[at : int(start)], "<" + " ".join([name[0].upper(), *name[1:]]) + ">" if general else ""]
                    at = max(at, int(stop))
                out.append("".join(done) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return found.join(names, "row", "left").select("doc_id", "text", "spans", "names").mapInArrow(run, "doc_id long, text string")
